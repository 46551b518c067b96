"""All queries of the core by name, with the SQL that states their results.

A query is a function of (session, folder); its SQL runs in DuckDB on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loamweave.plans import bundle_queries, graph_queries, ingest_queries, retrieval_queries, text_queries

_PARTS = (text_queries, retrieval_queries, bundle_queries, graph_queries, ingest_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for part in _PARTS for name, (run, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
