"""Operators for large training-data pipelines: tokens, quality, search, duplicates, packing."""
