"""Readers for mixed text files and for matcher inputs, and the writers."""
