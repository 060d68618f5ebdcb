"""Document ingestion and hybrid retrieval on Spark."""
