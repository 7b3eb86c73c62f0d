"""Operators for training-data pipelines: dedup, packing, tokens, quality, privacy, search."""
