"""tidemark: market-data research on Spark DataFrames."""
