"""Structured Streaming forms of the upsert and of keyed state."""
