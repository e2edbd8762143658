"""Vector search over versioned datasets, planned as Spark DataFrames."""
