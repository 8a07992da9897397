"""Names of the queries, their functions and their DuckDB SQL."""

from __future__ import annotations

from . import span_queries, text_queries


def queries() -> dict:
    return text_queries.QUERIES | span_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return text_queries.SQL | span_queries.SQL
