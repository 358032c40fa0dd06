"""Structured Streaming forms of the cumulative operators."""
