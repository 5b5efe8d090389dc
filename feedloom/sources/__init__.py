"""Payloads to records: RSS, pages, links, JSON and sitemaps."""
