"""blockwise: multi-layer analytics on Spark DataFrames."""
