"""Show-catalog extraction and retrieval on Spark DataFrames."""
