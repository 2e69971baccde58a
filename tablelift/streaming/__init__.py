"""Structured Streaming versions of the load and the progress check."""
