"""Reports and fact builders, each a function from DataFrames to a DataFrame."""
