"""Operators for preparing language-model training data: deduplication, scoring, tokenising and packing."""
