"""Structured Streaming over feedback and listens."""
