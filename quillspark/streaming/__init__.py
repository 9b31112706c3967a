"""Structured Streaming wrappers of the batch transforms."""
