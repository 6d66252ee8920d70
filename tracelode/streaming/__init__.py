"""Structured Streaming forms of the limits, caches and edits."""
