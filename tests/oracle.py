"""Compare a query with its SQL on DuckDB, rows in any order."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x: object) -> object:
    if x is None or str(x) in ("<NA>", "NaT") or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if isinstance(x, (int, float)) or type(x).__name__.startswith(("int", "float")):
        return float(x)
    return str(x)


def rows(frame) -> list:
    return sorted((tuple(_cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


def check(spark: SparkSession, folder: str, query, sql: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = query(spark, folder).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
