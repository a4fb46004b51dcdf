"""codexmill: retrieval, text processing and evaluation analytics on Spark DataFrames."""
