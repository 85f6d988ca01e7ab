"""Chunked dataset analytics on Spark DataFrames."""
