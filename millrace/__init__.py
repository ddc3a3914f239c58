"""A batch analytics engine for retail sales data on Spark DataFrames."""
