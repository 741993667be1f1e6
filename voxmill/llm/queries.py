"""All queries of this subpackage, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("bpe", "chat_format", "embedding_dedup", "line_dedup", "minhash_dedup", "mixing", "sharding", "token_file", "toxicity", "exact_dedup", "lexical_search", "fingerprints", "collocations")
QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
