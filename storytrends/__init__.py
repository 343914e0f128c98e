"""Topics and trends in large collections of dated text posts, on Spark DataFrames."""
