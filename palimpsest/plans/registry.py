"""All queries of the archive operators, by name."""

from __future__ import annotations

from . import diff_queries, graph_queries, line_queries, path_queries

_MODULES = (diff_queries, graph_queries, path_queries, line_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}


def flagship(spark, sf_dir: str):
    return QUERIES["d1_snapshot_diff"](spark, sf_dir)
