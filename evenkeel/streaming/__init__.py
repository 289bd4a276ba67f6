"""Structured Streaming jobs over append-only logs."""
