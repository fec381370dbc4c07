"""Rules as DataFrames: bodies, heads, aggregates, fixed points."""
