"""Operators of a training-data pipeline: deduplication, scoring, mixing, tokens, search and language."""
