"""Analytics operators on Spark DataFrames."""
