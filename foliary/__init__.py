"""foliary: document retrieval analytics on Spark DataFrames."""
