"""Structured Streaming jobs around a phased migration."""
