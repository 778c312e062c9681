"""Document-mark analytics on Spark DataFrames."""
