"""Analytics engine over Spark DataFrames."""

__version__ = "0.2.0"
