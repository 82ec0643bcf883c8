"""Structured Streaming forms of the page, chunk and navigation operators."""
