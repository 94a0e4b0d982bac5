"""Operators for large-scale training-data pipelines: extraction, deduplication, filters, mixing, tokens, search."""
