"""Transaction-graph analytics on Spark DataFrames."""
