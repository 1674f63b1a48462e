"""Site-intelligence analytics on Spark DataFrames."""
