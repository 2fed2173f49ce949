"""Retail analytics and data-hub jobs on Spark DataFrames, Spark SQL and Structured Streaming."""
