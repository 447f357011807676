"""Structured Streaming forms of the event and presence operators."""
