"""Operators for large training-data pipelines: archives, tokenization, scoring, filtering and deduplication of text."""
