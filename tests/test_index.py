from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import index
from docspark.operators import retrieval as R
from docspark.session import with_checkpoints
from docspark.sources import readers


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents in topics: a few words of all, and many of their own topic."""
    with_checkpoints(spark)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice([f"common{rng.randrange(5)}", f"topic{i // 40}x{rng.randrange(30)}", f"rare{rng.randrange(3000)}"]) for _ in range(rng.randrange(5, 60)))) for i in range(1200)]
    return spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")


def test_pruned_search_equals_bm25_and_reads_less_than_half(spark, corpus, tmp_path):
    folder = str(tmp_path / "index")
    assert index.probe(spark, folder) == {"exists": False, "version": None, "documents": 0, "terms": 0, "blocks": 0}
    assert index.build(corpus, folder, 3)
    asks = spark.createDataFrame([(i, f"common1 topic{i}x{i} topic{i}x3 topic{i}x3 rare{i}") for i in (2, 11, 25)] + [(99, "nowhere"), (98, "")], "query_id long, text string")
    postings = readers.read_version(spark, folder, 3, ["postings"])["postings"]
    hits, blocks = index.search(asks, postings)
    want = R.keyword_topk(asks, corpus)
    columns = ["query_id", "doc_id", "score", "rank"]
    assert sorted(map(tuple, hits.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    # blocks are read once for all queries, so few queries are needed to leave some out
    of_terms = postings.join(R.query_terms(asks).select("term").distinct(), "term", "left_semi").count()
    assert 0 < blocks.count() < of_terms / 2
    seen = index.probe(spark, folder)
    assert seen["documents"] == 1202 and seen["version"] == 3 and seen["blocks"] == postings.count()


def test_build_is_idempotent_and_mends_a_broken_one(spark, corpus, tmp_path):
    folder, few = str(tmp_path / "index"), corpus.limit(50)
    index.tables(few)["postings"].write.parquet(f"{folder}/v=1/postings")  # broke off
    assert not index.probe(spark, folder)["exists"]
    assert index.build(few, folder, 1) and not index.build(few, folder, 1)
    postings = readers.read_version(spark, folder, 1, ["postings"])["postings"]
    assert postings.groupBy("term", "segment").count().where("count > 1").count() == 0
    assert postings.select(F.explode("docs")).select("col.doc_id").distinct().count() == few.where("text <> \'\'").count()


def test_torn_commit_and_torn_version_fall_back(spark, tmp_path):
    folder = str(tmp_path / "state")
    for version in (1, 2):
        readers.write_snapshot(spark.range(version), folder, version)
    (tmp_path / "state" / "commits" / "torn.json").write_text('{"version": 3, "tab')
    assert readers.versions(spark, folder) == [1, 2]
    for part in (tmp_path / "state" / "v=2").glob("part-*"):
        part.write_bytes(b"no parquet")
    for check in (tmp_path / "state" / "v=2").glob(".*.crc"):
        check.unlink()
    assert readers.read_snapshot(spark, folder).count() == 1
    for part in (tmp_path / "state" / "v=1").glob("part-*"):
        part.unlink()
    with pytest.raises(FileNotFoundError):
        readers.read_snapshot(spark, folder)


def test_blocks_are_shuffled_once_and_right(spark, corpus):
    own = index.tables(corpus.repartition(3), 8)
    plan = own["postings"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan
    want = {(i, t): text.split().count(t) for i, text in map(tuple, corpus.collect()) for t in set((text or "").split())}
    rows = own["postings"].collect()
    assert {(d.doc_id, r.term): d.tf for r in rows for d in r.docs} == want and sum(len(r.docs) for r in rows) == len(want)
    df = {t: sum(1 for _, u in want if u == t) for t in ("common1", "rare7", "topic3x4")}
    assert {r.term: r.df for r in rows if r.term in df} == {t: n for t, n in df.items() if n}
    of = {r.doc_id: (r.segment, r.dl) for r in own["lengths"].collect()}
    assert len(of) == 1202 and of[5000][1] == 0 and all(of[d.doc_id][0] == r.segment for r in rows for d in r.docs)
    assert max(sum(1 for s, _ in of.values() if s == x) for x in {s for s, _ in of.values()}) <= 8
