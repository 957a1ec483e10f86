"""Readers of claim and report collections, and sinks."""
