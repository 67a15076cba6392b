"""Vector search, graph indexes and data preparation on Spark DataFrames."""
