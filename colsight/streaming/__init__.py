"""Structured Streaming versions of cleaning and running statistics."""
