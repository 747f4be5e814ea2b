"""DataFrame operators: each takes and returns lazy DataFrames."""
