"""The intake rules as Structured Streaming jobs."""
