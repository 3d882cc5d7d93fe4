"""Analytics engine over Spark DataFrames."""
