"""The engine's operators; each takes and returns DataFrames."""
