"""Incrementally maintained views on Spark DataFrames."""
