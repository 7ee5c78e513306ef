"""Operators of training-data pipelines: search, packing, deduplication, sharding, privacy, quality."""
