"""Analytics for positive-unlabeled data on Spark DataFrames."""

__version__ = "0.1.0"
