"""Collecting, versioning and operating on feed-like data with Spark DataFrames."""
