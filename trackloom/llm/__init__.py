"""Operators for training-data pipelines (tokens, packing, clean-up, near-duplicates, scoring)."""
