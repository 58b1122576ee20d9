"""Lodetext: full-text search and analytics over Parquet, built on Spark DataFrames."""
