"""Analytics of labelled event trains on Spark DataFrames."""
