from __future__ import annotations

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docspark.functions import nested
from docspark.operators import embed, graph
from docspark.session import with_checkpoints


def made(rng: random.Random, depth: int):
    kind = rng.randrange(6) if depth else rng.randrange(4)
    if kind < 4:
        return [None, True, rng.randrange(100), rng.choice(["x", "a b", "é", '"q"', ""])][kind]
    return {rng.choice("zyxw") + str(i): made(rng, depth - 1) for i in range(rng.randrange(4))} if kind == 4 else [made(rng, depth - 1) for _ in range(rng.randrange(13))]


def plain(value) -> list[str]:
    if isinstance(value, dict):
        return [x for k in sorted(value) for x in plain(value[k])]
    if isinstance(value, list):
        return [x for v in value for x in plain(v)]
    return [str(value)]


def test_leaves_of_any_depth_equal_a_recursion(spark):
    with_checkpoints(spark)
    rng = random.Random(1)
    values = [made(rng, 5) for _ in range(60)] + [[[[[[[["deep"]]]]]]], {}, [], None]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(100, "{no json"), (101, None)]
    got = {r.i: r.text for r in nested.flattened(spark.createDataFrame(rows, "i long, args string"), "i", "args").collect()}
    assert got == {i: " ".join(plain(v)) for i, v in enumerate(values)} | {100: "{no json", 101: "None"}


def test_safe_json_has_one_form(spark):
    texts = ['{"b": 1, "a": [true, null]}', '{"a":[true,null],"b":1}', "plain \"text\"\n", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    assert [r[0] for r in rows.orderBy("i").select(nested.safe_json(F.col("t"))).collect()] == ['{"a":[true,null],"b":1}', '{"a":[true,null],"b":1}', json.dumps(texts[2]), '""', "null"]


def test_vectors_keep_their_keys(spark):
    docs = spark.createDataFrame([(i, None if i % 9 == 0 else f"Word{i % 7} other text {'x' * (i % 3)}") for i in range(250)], "doc_id long, text string")
    one = {r.doc_id: r.vector for r in embed.embedded(docs, "doc_id").collect()}
    other = {r.doc_id: r.vector for r in embed.embedded(docs.repartition(5).orderBy(F.rand(3)), "doc_id", batch=7).collect()}
    assert one == other and len(one) == 250
    direct = embed.hashed_terms()(pa.array([r.text for r in docs.orderBy("doc_id").collect()])).astype(np.float32)
    assert all(np.array_equal(np.array(one[i], np.float32), direct[i]) for i in range(250))
    assert np.allclose(np.linalg.norm(direct, axis=1), [0.0 if i % 9 == 0 else 1.0 for i in range(250)])
    kept = embed.with_vectors(docs, embed.embedded(docs.where("doc_id < 200"), "doc_id"), "doc_id")
    assert kept.where("vector is null").count() == 50


def test_embedders_are_pluggable(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "bb")], "doc_id long, text string")
    sizes = embed.embedded(docs, "doc_id", make=lambda: lambda texts: np.array([[len(t.as_py()), 0.0] for t in texts])).collect()
    assert {r.doc_id: r.vector for r in sizes} == {1: [1.0, 0.0], 2: [2.0, 0.0]}
    with pytest.raises(ValueError, match="unknown embedder"):
        embed.embedded(docs, "doc_id", name="none")
    with pytest.raises(Exception, match="1 vectors for 2 texts"):
        embed.embedded(docs.coalesce(1), "doc_id", make=lambda: lambda texts: np.zeros((1, 2))).collect()


def test_triples_of_other_types_stay(spark):
    rows = spark.createDataFrame([("Blur", "NukeNode", "HAS_KNOB", "size", "Knob"), ("blur", "NukeNode", "HAS_KNOB", "Size", "Knob"), ("blur", "Operation", "HAS_KNOB", "size", "Knob"), ("Blur", "NukeNode", "HAS_KNOB", "size", "Channel")], ", ".join(f"{c} string" for c in graph.COLUMNS))
    got = {tuple(r) for r in graph.dedup_case(rows, graph.COLUMNS).select(*graph.COLUMNS).collect()}
    assert got == {("Blur", "NukeNode", "HAS_KNOB", "size", "Knob"), ("blur", "Operation", "HAS_KNOB", "size", "Knob"), ("Blur", "NukeNode", "HAS_KNOB", "size", "Channel")}


def test_input_rows(spark):
    head = "x. Inputs and Controls Connection Type Connection Name Function "
    texts = {
        "Blur": head + "Input img The picture. Input B If given, it is used. Output out The end. mask Optional matte. Nuke 13 Input no The more.",
        "Merge": head + "Input unnamed The layer below all others. Input Unnamed A second image. Input The rest. function The name of it.",
        "Twice": head + "Input A The one.  Input a The other. Mid sentence, Input Q The not a row. more words here and When it ends",
        "None": "Input a The row outside of a table.",
        "": head + "Input a The row of no page.",
    }
    got = {(r.subject_name, r.object_name) for r in graph.input_triples(spark.createDataFrame([*texts.items(), ("Null", None)], "name string, text string")).collect()}
    assert got == {("Blur", "img input"), ("Blur", "B input"), ("Blur", "mask input"), ("Merge", "The layer below all input"), ("Merge", "image input"), ("Twice", "A input")}


def test_input_rows_are_read_in_all_tasks(spark):
    """One file's pages are dealt out before anything is looked for in them, and equal pages are read once."""
    text = "Inputs and Controls Connection Type Connection Name Function Input img The picture. mask Optional matte."
    got = graph.input_triples(spark.createDataFrame([("Blur", text), ("blur", text)] * 30, "name string, text string").coalesce(1))
    assert sorted((r.subject_name.lower(), r.object_name) for r in got.collect()) == [("blur", "img input"), ("blur", "mask input")]
    above, below = got._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
    assert "split(" in above and "split(" not in below and "regexp" not in below
    assert "min(pos" in above.split("Window")[-1]
