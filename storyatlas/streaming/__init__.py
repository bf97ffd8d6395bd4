"""Extras: the incremental passes as Structured Streaming jobs."""
