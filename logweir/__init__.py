"""logweir: log storage, search and data processing on DataFrames, Spark SQL and Structured Streaming."""
