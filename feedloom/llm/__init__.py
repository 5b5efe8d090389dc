"""Operators of a training-data pipeline: search, packing, deduplication, archives, sharding, token files, PII, contamination and language ID."""
