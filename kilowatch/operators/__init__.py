"""DataFrame operators. Each takes and returns DataFrames and triggers no job."""
