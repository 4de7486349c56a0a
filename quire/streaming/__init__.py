"""Structured Streaming forms of imports, job states and view events."""
