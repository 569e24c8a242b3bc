"""Search-experiment retrieval analytics on Spark DataFrames."""
