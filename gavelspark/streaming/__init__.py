"""Structured Streaming forms of the serving-time operators."""
