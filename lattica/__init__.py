"""Analytics operators for ordered, nested and document-like data, on Spark DataFrames."""
