"""Structured Streaming forms of the incremental work."""
