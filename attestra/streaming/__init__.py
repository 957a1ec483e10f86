"""Structured Streaming forms of the latest-per-key and windowed operators."""
