"""Readers of raw lines, the normalisers that turn them into events, and sinks."""
