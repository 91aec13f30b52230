"""tidemark: causal change-log analytics on Spark DataFrames."""
