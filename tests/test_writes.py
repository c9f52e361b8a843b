from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from docspark.operators import caches, store
from docspark.plans import writes
from docspark.sources import readers
from tests.oracle import check

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("name", sorted(writes.QUERIES))
def test_query_equals_sql(spark, data, name):
    check(spark, data, writes.QUERIES[name], writes.SQL[name])


def test_put_refreshes_expiry(spark):
    cache = spark.createDataFrame([("a", "old", T0), ("b", "kept", T0)], "key string, answer string, expires_at timestamp")
    puts = spark.createDataFrame([("a", "x", T0), ("a", "y", T0 + timedelta(hours=1)), ("a", "z", T0 + timedelta(hours=1)), (None, "n", T0), ("c", None, T0)], "key string, answer string, at timestamp")
    got = {r.key: (r.answer, r.expires_at) for r in caches.put(cache, puts).collect()}
    assert got == {"a": ("z", T0 + timedelta(hours=7)), "b": ("kept", T0)}
    assert caches.put(cache.limit(0), puts.limit(0)).count() == 0


def test_semantic_put_stores_grounded_answers_once(spark):
    schema = "scope string, query string, answer string, vector array<float>, chunks_used int, sources array<string>, at timestamp"
    puts = spark.createDataFrame([("s", "q", "a", [1.0], 2, ["u"], T0), ("s", "q", "a", [1.0], 2, ["u"], T0 + timedelta(hours=2)), ("s", "q", "b", [1.0], 0, ["u"], T0), ("s", "q", "c", [1.0], 1, [], T0), (None, "q", "d", [0.5], 1, ["u"], T0)], schema)
    empty = spark.createDataFrame([], "entry_id string, scope string, answer string, vector array<float>, expires_at timestamp")
    once = caches.semantic_put(empty, puts)
    assert sorted((r.answer, r.expires_at) for r in once.collect()) == [("a", T0 + timedelta(hours=8)), ("d", T0 + timedelta(hours=6))]
    again = caches.semantic_put(once, puts.withColumn("at", puts["at"] + timedelta(days=1)))
    assert sorted((r.answer, r.expires_at) for r in again.collect()) == [("a", T0 + timedelta(hours=32)), ("d", T0 + timedelta(hours=30))]


def test_delete_ignores_unknown_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    ids = spark.createDataFrame([(1,), (1,), (9,), (None,)], "k long")
    assert sorted(r.v for r in store.delete(rows, ids, "k").collect()) == ["b", "c"]
    assert store.delete(rows, ids.limit(0), "k").count() == 3


def test_runs_are_written_with_summaries(spark, tmp_path):
    def case(status, **scores):
        return ("c", "q", status, "e", "a", [], scores, None)

    folder = f"{tmp_path}/runs"
    for name, time, cases in (("r9", "2024-01-01", [case("scored", m=1.0, k=0.5), case("scored", m=0.0), case("errored", m=9.0)]), ("r1", "2024-01-03", [case("errored")]), ("r5", "2024-01-02", [])):
        readers.write_run(spark.createDataFrame([(name, time, "abc", cases)], readers.RUN), folder)
    assert [r.run_id for r in readers.newest_runs(spark, folder).collect()] == ["r1", "r5"]
    assert [(r.run_id, r.case_count, r.avg_scores) for r in readers.run_summaries(spark, folder).collect()] == [("r1", 1, {}), ("r5", 0, {}), ("r9", 3, {"m": 0.5, "k": 0.25})]
