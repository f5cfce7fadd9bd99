"""Structured Streaming operators (group H)."""
