"""Continuous analysis over Structured Streaming."""
