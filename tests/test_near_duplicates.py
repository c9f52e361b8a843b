from __future__ import annotations

import hashlib
import random
import re

from docspark.operators import dedup, store
from docspark.plans import ingest
from docspark.session import kept, with_checkpoints


def test_kept_rows_claim_no_partitioning(spark):
    """A union of kept tables that claim a partitioning, but have another number of partitions, can't be joined."""
    rows = kept(spark.range(100).repartition(4, "id"))
    assert "hash" not in rows._jdf.queryExecution().executedPlan().outputPartitioning().toString().lower()
    assert rows.count() == 100


def test_gate_joins_after_several_rounds(spark):
    with_checkpoints(spark)
    n = 6
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    arrivals = spark.createDataFrame([(i, f"new{i}", "text") for i in range(n)], "doc_id long, url string, text string")
    got = store.gated_upsert(ids.where("doc_id < 0").selectExpr("doc_id", "'' as url"), arrivals, pairs).collect()
    assert {r.doc_id: r.canonical for r in got} == {i: None if i % 2 == 0 else i - 1 for i in range(n)}


def test_signatures_are_those_of_a_loop(spark):
    """Letters beyond one byte or plane, texts shorter than a shingle, and more letters than fit one key."""
    rng = random.Random(2)
    texts = ["abcde", "abcd", "", None, "Grüße 日本語テキスト \U0001f600 x", "ab " * 400, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(9000)), "".join(rng.choice("abc d") for _ in range(3000))]
    rows = dedup.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 16)
    want = {}
    for i, text in enumerate(texts):
        t = re.sub("[ \t\n\r\f\v]+", " ", (text or "").lower()).strip(" ")
        own = [int(hashlib.md5(t[k : k + 5].encode()).hexdigest()[:7], 16) for k in range(len(t) - 4)]
        if own:
            want[i] = [min((a * h + b) % dedup.PRIME for h in own) for a, b in map(dedup.coefficients, range(16))]
    assert {r.doc_id: r.sig for r in rows.collect()} == want


def test_copies_are_not_compared_one_by_one(spark, tmp_path):
    """Pairs and gate of a table with copies are those of a loop over all documents, and only representatives are compared."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(4)]
    texts = [*base, base[0] + " x", *base, base[0].upper() + "  X", *[base[1]] * 5, "abc", None, "abc", base[0] + " xy"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    normal = [re.sub(" +", " ", (t or "").lower()).strip(" ") for t in texts]
    sets = [{t[k : k + 5] for k in range(len(t) - 4)} for t in normal]
    want = {(i, j): round(len(x & y) / len(x | y), 6) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and x | y}
    want = {k: v for k, v in want.items() if v >= 0.85}
    rows = ingest.near_dup_verified(spark, str(tmp_path)).collect()
    assert {(r.a, r.b): r.jaccard for r in rows} == want and len(rows) == len(want)
    own, pairs = ingest._candidates(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert pairs.count() <= 3 < len(want)  # three texts alike, in any number of copies
    stays, gate = [], {}
    for i in range(len(texts)):
        gate[i] = min((k for k in stays if (k, i) in want), default=None)
        stays += [i] if gate[i] is None else []
    assert {r.doc_id: r.canonical for r in ingest.near_dup_gate(spark, str(tmp_path)).collect()} == gate
