"""Named queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from . import code_queries, document_queries, graph_queries, metric_queries, rule_queries, stat_queries, store_queries, stream_queries, symbol_queries, text_queries, vector_queries

_MODULES = (text_queries, vector_queries, graph_queries, symbol_queries, stat_queries, document_queries, rule_queries, code_queries, metric_queries, stream_queries, store_queries)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
