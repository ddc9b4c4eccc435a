"""DataFrame operators. Each is a pure function of DataFrames; none collects rows."""
