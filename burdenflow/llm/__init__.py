"""Operators for preparing training text, each on Spark DataFrames."""
