"""Nearest vectors against a plain loop; budgets of hot groups."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import caches, nearest, retrieval, store


def cosine(x, y):
    good = x and y and len(x) == len(y) and all(v is not None and math.isfinite(v) for v in x + y)
    size = good and math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
    return round(1 - sum(a * b for a, b in zip(x, y)) / size, 9) if size else None


def vectors(n, seed):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(n)]
    copies = [(n + i, rows[i % 3][1]) for i in range(n // 2)]
    return rows + copies + [(10_000, None), (10_001, [0.0] * 4), (10_002, [1.0, None, 2.0, 3.0]), (10_003, [1.0, float("nan"), 0.0, 0.0]), (10_004, [1.0, 2.0]), (10_005, [])]


@pytest.mark.parametrize("block, size", [(1024, 2048), (7, 5)])
def test_topk_equals_a_loop(spark, monkeypatch, block, size):
    monkeypatch.setattr(nearest, "QUERY_BLOCK", block)
    monkeypatch.setattr(nearest, "SLICE", size)
    base, asks = vectors(60, 1), vectors(20, 2) + [(-1, [2.0, 4.0])]
    b = spark.createDataFrame(base, "doc_id long, vector array<double>").repartition(3)
    got = retrieval.vector_topk(spark.createDataFrame(asks, "query_id long, vector array<double>"), b, 5).collect()
    want = set()
    for q, x in asks:
        near = sorted((d, i) for i, y in base if (d := cosine(x, y)) is not None)[:5]
        want |= {(q, i, n + 1) for n, (_, i) in enumerate(near)}
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got} == want and len(got) == len(want)


def test_text_ids_and_no_rows(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    b = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0])], "doc_id string, vector array<float>")
    assert [(r.query_id, r.doc_id, r.distance) for r in retrieval.vector_topk(q, b, 2).orderBy("rank").collect()] == [("q", "a", 0.0), ("q", "b", 0.0)]
    assert retrieval.vector_topk(q.where("false"), b).count() == 0
    assert retrieval.vector_topk(q, b.where("false")).count() == 0


def test_semantic_lookup_stays_in_its_scope(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SLICE", 3)
    r = random.Random(3)
    entries = [(i, r.choice(["a", "b", None]), [r.gauss(0, 1) for _ in range(3)], r.choice([1, 9])) for i in range(50)]
    asks = [(i, r.choice(["a", "b", "c", None]), [r.gauss(0, 1) for _ in range(3)]) for i in range(30)]
    cache = spark.createDataFrame(entries, "entry_id long, scope string, vector array<double>, expires_at int")
    got = caches.semantic_lookup(spark.createDataFrame(asks, "ask_id long, scope string, vector array<double>"), cache, F.lit(5), 0.1).collect()
    want = []
    for i, s, x in asks:
        d, e = min(((cosine(x, y), e) for e, t, y, until in entries if t == s and s is not None and until > 5), default=(9, None))
        want.append((i, e if d <= 0.1 else None, "hit" if d <= 0.1 else "miss"))
    assert sorted(map(tuple, got)) == want


def test_budget_of_a_hot_group(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot"] * 8 + ["x", None]), i, r.randrange(0, 50)) for i in range(400)]
    got = store.within_budget(spark.createDataFrame(rows, "g string, i int, size int").repartition(5), "g", [F.col("i").desc()], "size", 900)
    assert got.columns == ["g", "i", "size", "before", "taken"]
    want, used = set(), {}
    for g, i, size in reversed(rows):
        before = used.get(g, 0)
        if before < 900:
            want.add((g, i, size, before, min(size, 900 - before)))
        used[g] = before + size
    assert set(map(tuple, got.collect())) == want
