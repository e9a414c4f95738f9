"""Collects the queries of all plan modules."""

from __future__ import annotations

from inkgrove.plans import graph, maintenance, markdown, records, retrieval

MODULES = (retrieval, graph, markdown, maintenance, records)
FLAGSHIP = "keyword_topk"


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
