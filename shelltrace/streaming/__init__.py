"""Structured Streaming versions of ingest and preprocessing."""
