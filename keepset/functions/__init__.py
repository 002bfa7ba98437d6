"""Column-level helpers: vectors, repeatable randomness, input guards."""
