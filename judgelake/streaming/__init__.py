"""Structured Streaming twins of the batch operators on progress events."""
