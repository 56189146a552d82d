"""Structured Streaming jobs over landed feed snapshots."""
