"""Media-catalogue analytics on Spark: DataFrame, SQL and Structured Streaming."""
