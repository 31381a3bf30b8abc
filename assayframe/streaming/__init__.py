"""Structured Streaming forms of the event-log operators."""
