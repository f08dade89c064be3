"""Structured Streaming versions of the usage roll-ups."""
