from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from docspark.llm import langid, mixing
from tests.llm.test_ops import WORD, brute_components, documents, near_rows, odd_rows, word_sets


def test_stages_in_turn(spark, tmp_path):
    rows = odd_rows() + [(1000 + i, *r[1:]) for i, *r in [(x[0], *x) for x in near_rows()[:20]]]
    docs = documents(rows, spark)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "language_id":
            sure = {r.doc_id for r in langid.language_report(before).collect() if r.lang_pred != "und" and r.score >= langid.MIN_SCORE}
            assert {r.doc_id for r in docs.collect()} == sure
        if name == "near_duplicates":
            sets = word_sets([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in docs.collect()) == sorted(set(brute_components(sets).values()))
        if name == "mixing":
            took = mixing.taken(before)
            words = sum(len(WORD.findall(r.text)) for r in docs.collect())
            assert words == took.agg(F.sum("taken")).first()[0]
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in took.where("taken > 0").collect()}
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}


def test_run(spark, data):
    rows = corpus_pipeline.run(spark, data)
    assert rows.count() > 0 and "sequence_id" in rows.columns


def test_columns_with_the_names_of_working_columns_keep_their_values(spark, tmp_path):
    names = ["_row", "row", "_doc", "key", "_group", "_own", "_rank", "_first", "sig"]
    plain = documents([(i, " ".join(f"das wort {i} {k} und" for k in range(60)), "de", "a") for i in range(1, 9)], spark).drop(*names)
    docs = plain.select("*", *[(F.col("doc_id") * 100 + k).alias(n) for k, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = docs.collect()
        assert got and all([r[n] for n in names] == [r.doc_id * 100 + k for k in range(len(names))] for r in got)


@pytest.mark.parametrize("case", ["empty", "nulls", "long"])
def test_stages_of_odd_tables(spark, tmp_path, case):
    words = " ".join(f"wort{i % 997}x" for i in range(120_000))
    rows = {"empty": [], "nulls": [(None, None, None, None), (1, None, "en", None), (None, None, None, "a")], "long": [(1, words, "de", "a"), (2, words, "de", None), (3, "ein wort und noch ein wort mehr", "de", "a")]}[case]
    docs = documents(rows, spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert name == "packing" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    got = docs.collect()
    if case == "long":
        assert {r.doc_id for r in got} <= {1, 3} and sum(r.length for r in got) > 120_000
    else:
        assert not got
