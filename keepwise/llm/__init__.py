"""Operators of a training-data pipeline: deduplication, mixing, tokens, archives, search, formatting."""
