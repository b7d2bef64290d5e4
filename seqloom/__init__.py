"""Sequence, interval and collinearity analytics on Spark DataFrames."""
