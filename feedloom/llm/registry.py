"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import conversations, decontaminate, langid, lexical, near_dedup, packing, pii, repeats, sharding, token_counts, token_files, topk, warc

MODULES = (topk, packing, repeats, warc, sharding, token_files, pii, near_dedup, decontaminate, langid, conversations, lexical, token_counts)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
