"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docspark.plans import fulltext, ingest, ingestion, nested, replies, retrieval, signals, streams, writes

MODULES = [retrieval, fulltext, nested, ingestion, ingest, signals, replies, streams, writes]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
