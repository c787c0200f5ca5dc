"""tidemark: point-in-time research data on Spark DataFrames."""
