"""Operators of a training-data pipeline: near duplicates, packing, scoring, search, token files."""
