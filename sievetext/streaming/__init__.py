"""Structured Streaming form of the row-wise part."""
