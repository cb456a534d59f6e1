"""All queries of the core, with their SQL where SQL can express them."""

from __future__ import annotations

from skillweave.plans import score_queries, table_queries, text_queries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _m in (text_queries, score_queries, table_queries):
    QUERIES.update(_m.Q)
    ORACLE.update(_m.SQL)
