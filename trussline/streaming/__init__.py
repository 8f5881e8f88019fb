"""Structured Streaming jobs over append-only feeds."""
