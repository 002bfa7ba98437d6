"""keepset: keep the T rows of a large table that a workload needs most."""
