"""Structured Streaming over arriving documents."""
