"""Routing-registry analytics and data preparation on Spark DataFrames."""
