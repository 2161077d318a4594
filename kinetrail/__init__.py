"""Keyed trajectory analytics on Spark DataFrames."""
