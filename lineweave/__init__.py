"""Analytics over transition networks, on Spark DataFrames."""
