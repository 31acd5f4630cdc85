"""A query and data engine for typed objects on Spark DataFrames."""
