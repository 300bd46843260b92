"""A typed pipeline query language over Spark DataFrames."""
