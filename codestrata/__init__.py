"""codestrata: repository analytics on Spark DataFrames."""
