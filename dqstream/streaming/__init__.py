"""The gate as a Structured Streaming job."""
