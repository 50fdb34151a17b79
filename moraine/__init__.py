"""moraine: content-addressed archive analytics on Spark DataFrames."""
