"""Relational operators over DataFrames: vectors, matching, intents."""
