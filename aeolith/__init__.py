"""Gridded time-series analytics on Spark DataFrames."""
