"""Fitness-landscape analytics on Spark DataFrames."""
