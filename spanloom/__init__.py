"""Structured, ranked full-text search and retrieval analytics on Spark DataFrames."""
