"""Order-risk analytics on Spark DataFrames."""
