"""The queries and SQL of all training-data operators, in the order of their numbers."""

from __future__ import annotations

from tessellate.llm import (
    exact_dedup,
    language_id,
    mixing,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    simhash,
    token_counts,
    warc,
)

MODULES = (
    mixing,
    exact_dedup,
    simhash,
    quality_rules,
    token_counts,
    quality_classifier,
    warc,
    language_id,
    packing,
    pii,
)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
