"""Structured Streaming on the same definitions."""
