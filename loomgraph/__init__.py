"""Analytics over source trees, expressed as Spark DataFrames."""
