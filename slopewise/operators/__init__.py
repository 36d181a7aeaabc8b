"""DataFrame operators. Each takes and returns DataFrames with column names as arguments."""
