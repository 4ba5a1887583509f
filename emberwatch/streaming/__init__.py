"""Structured Streaming ingest and detection on the same transforms as batch."""
