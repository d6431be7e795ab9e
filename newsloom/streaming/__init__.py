"""The incremental runs as Structured Streaming jobs."""
