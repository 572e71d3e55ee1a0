"""Event-sequence graph analytics on Spark DataFrames."""
