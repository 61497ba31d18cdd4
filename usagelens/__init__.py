"""Session usage analytics on Spark DataFrames."""
