"""All registered queries of the retrieval engine and their DuckDB equivalents."""

from __future__ import annotations

from . import graph_queries, layout_queries, metric_queries, search_queries, stage_queries, text_queries  # noqa: F401  (they register)
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
