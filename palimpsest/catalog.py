"""All queries over the driver's tables and the DuckDB SQL that each must equal."""

from __future__ import annotations

from .plans import page_queries, pair_queries, text_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (text_queries, page_queries, pair_queries):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE
