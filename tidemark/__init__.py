"""Base-pair-resolution 5'-end count analytics on Spark DataFrames."""
