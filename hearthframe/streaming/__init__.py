"""Structured Streaming forms of the snapshot layer."""
