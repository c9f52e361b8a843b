from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import chunks, graph, guards, pages, retrieval, signals, store
from docspark.plans import ingest, streams
from docspark.session import with_checkpoints
from docspark.sources import readers
from docspark.streaming import stateful


def test_line_chunks_keep_all_lines_and_move_on(spark):
    text = "\n".join(["x" * 30] * 50 + ["y" * 500])
    rows = chunks.line_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), most=200, overlap=2).collect()
    assert rows[0].start_line == 1 and rows[-1].end_line == 51
    assert {r.doc_id for r in rows} == {1}
    assert all(b.start_line <= a.end_line + 1 and b.start_line > a.start_line for a, b in zip(rows, rows[1:], strict=False))


def test_recursive_split_bounds_and_order():
    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(90)) for i in range(12))
    parts = chunks.recursive_split(text, 200, 50)
    assert all(len(p.split()) <= 200 for p in parts)
    assert {w for p in parts for w in p.split()} == set(text.split())


def test_word_windows_cover(spark):
    docs = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in (0, 1, 99, 100, 600, 601, 1100, 1101, 2345)], "doc_id long, text string")
    rows = chunks.word_chunks(docs).collect()
    for n in (1, 99, 100, 600, 601, 1100, 1101, 2345):
        own = sorted((r.chunk_index, r.first, r.n_words) for r in rows if r.doc_id == n)
        assert own[-1][1] + own[-1][2] == n and len(own) == (1 if n <= 600 else 1 - (600 - n) // 500)
    assert not [r for r in rows if r.doc_id == 0]


def test_near_duplicate_gate_is_greedy(spark):
    with_checkpoints(spark)
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    kept: list[int] = []
    want = {}
    for x in range(40):
        hit = [k for k in kept if (k, x) in pairs]
        want[x] = min(hit) if hit else None
        if not hit:
            kept.append(x)
    got = store.near_duplicate_gate(spark.createDataFrame(pairs, "a long, b long"), spark.range(40).withColumnRenamed("id", "doc_id")).collect()
    assert {r.doc_id: r.canonical for r in got} == want


def test_gate_on_documents_keeps_one_of_copies(spark, data):
    rows = ingest.near_dup_gate(spark, data)
    assert rows.count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_fusion_is_order_free(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, doc_id long, rank int")
    one, two = (sorted(map(tuple, retrieval.fuse(x).collect())) for x in ([a, b], [b, a]))
    assert one == two and dict((d, s) for _, d, s in one)[11] == round(1 / 61 + 1 / 62, 9)


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", 1, True), ("b", 1, True)], "url string, v int, indexed boolean")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "url string, v int")
    once = store.upsert(old, new, "url", {"indexed": F.lit(False)})
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, store.upsert(once, new, "url", {"indexed": F.lit(False)}).collect())) == [("a", 1, True), ("b", 2, False), ("c", 2, False)]


def test_ids_none_and_empty(spark):
    t = spark.range(3).withColumnRenamed("id", "k")
    assert store.select_ids(t, None, "k").count() == 3
    assert store.select_ids(t, t.where("k < 0"), "k").count() == 0


def test_within_budget_cuts_the_last(spark):
    rows = spark.createDataFrame([("r", i, 40) for i in range(5)], "g string, i int, size int")
    got = store.within_budget(rows, "g", [F.col("i")], "size", 100).orderBy("i").collect()
    assert [r.taken for r in got] == [40, 40, 20]


@pytest.mark.parametrize("url, want", [("http://a.org", "not https"), ("https://u:p@a.org/", "credentials"), ("https://10.0.0.1/x", "private address"), ("https://172.32.0.1/", None), ("https://a.org/b", None)])
def test_url_reason(spark, url, want):
    assert spark.range(1).select(pages.url_reason(F.lit(url))).first()[0] == want


def test_redaction(spark):
    text = "mail a.b@c.org, ip 10.1.2.3, card 4111 1111 1111 1111, ssn 123-45-6789, tel +1 212-555-0100"
    row = spark.range(1).select(guards.redacted(F.lit(text)).alias("t"), guards.entities(F.lit(text)).alias("e")).first()
    assert row.t == "mail [EMAIL_ADDRESS], ip [IP_ADDRESS], card [CREDIT_CARD], ssn [US_SSN], tel [PHONE_NUMBER]"
    assert row.e == sorted(guards.PATTERNS)


@pytest.mark.parametrize("changed, broke, unsafe, failed, want", [(0, 0, 0, 0, "ALLOW"), (1, 0, 0, 0, "REDACT"), (1, 0, 1, 0, "BLOCK"), (0, 0, 0, 1, "BLOCK"), (1, 1, 0, 0, "ALLOW")])
def test_decisions(spark, changed, broke, unsafe, failed, want):
    c = [F.lit(bool(x)) for x in (changed, broke, unsafe, failed)]
    assert spark.range(1).select(guards.decision(*c)).first()[0] == want


def test_control_triples(spark):
    text = "Control | Knob | Default | Function\nSize | size | 0 | Sets the 2 blurs of it, a b c d e f g.\nChans | N/A | rgb | Picks the channels.\nTab | tab | | none\nSIZE | SIZE | 0 | 12"
    page = spark.createDataFrame([("Blur", "Filter", text), ("Bare", "Filter", "no table"), (None, "Filter", text), ("Null", None, None)], "name string, section string, text string")
    got = {(r.subject_name, r.predicate, r.object_name) for r in graph.control_triples(page).collect()}
    assert got == {
        ("Blur", "BELONGS_TO", "Filter"), ("Blur", "HAS_KNOB", "size"), ("size", "KNOB_CONTROLS", "Sets the blurs of it a b c d"), ("Blur", "HAS_KNOB", "Chans"),
        ("Chans", "KNOB_CONTROLS", "Picks the channels"), ("Chans", "AFFECTS_CHANNEL", "image channels"), ("SIZE", "KNOB_CONTROLS", "documented behavior"),
    }


def test_control_rows_are_read_in_all_tasks_and_sorted_once_each(spark):
    """One file's pages are dealt out before anything is looked for in them, and repeats are gone before the sort."""
    text = "Size | size | 0 | Sets blurs.\nsize | SIZE | 0 | Sets blurs."
    pages = spark.createDataFrame([("Blur", "Filter", text)] * 50, "name string, section string, text string").coalesce(1)
    got = graph.control_triples(pages)
    assert sorted((r.subject_name, r.predicate, r.object_name) for r in got.collect()) == [("Blur", "BELONGS_TO", "Filter"), ("Blur", "HAS_KNOB", "size"), ("size", "KNOB_CONTROLS", "Sets blurs")]
    above, below = got._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
    assert "regexp_extract_all" in above and "regexp_extract_all" not in below
    assert "min(pos" in above.split("Window")[-1]


def test_gated_upsert_is_sequential(spark):
    with_checkpoints(spark)
    rng = random.Random(5)
    stored = [(i, f"u{i}") for i in range(15)]
    new = [(i, f"u{rng.randrange(15)}" if i % 4 == 0 else f"u{i}", "" if i % 7 == 0 else None if i % 11 == 0 else "text") for i in range(15, 50)]
    new = list({u: (i, u, t) for i, u, t in new}.values())
    pairs = sorted({tuple(sorted(rng.sample(range(50), 2))) for _ in range(70)})
    holds = {u: i for i, u in stored}
    want = {}
    for i, url, text in sorted(new):
        if not text:
            want[i] = ("empty", None)
        elif url in holds:
            want[i], holds[url] = ("updated", None), i
        else:
            hit = [k for k in holds.values() if (k, i) in pairs]
            want[i] = ("skipped", min(hit)) if hit else ("inserted", None)
            if not hit:
                holds[url] = i
    got = store.gated_upsert(spark.createDataFrame(stored, "doc_id long, url string"), spark.createDataFrame(new, "doc_id long, url string, text string"), spark.createDataFrame(pairs, "a long, b long"))
    assert {r.doc_id: (r.action, r.canonical) for r in got.collect()} == want
    assert {a for a, _ in want.values()} == {"empty", "updated", "skipped", "inserted"}


def test_regression_is_strict(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.5), ("z", 0.1)], "metric string, mean double")
    b = spark.createDataFrame([("x", 0.45), ("y", 0.44)], "metric string, mean double")
    assert {r.metric: r.regressed for r in signals.compare(a, b).collect()} == {"x": False, "y": True, "z": False}


def test_shingles_and_prettified(spark):
    r = spark.range(1).select(T.shingles(F.lit("abcdef\ng")).alias("s"), T.shingles(F.lit("abc")).alias("n"), T.prettified(F.lit("ContextualRelevancyMetric")).alias("p")).first()
    assert r.s == ["abcde", "bcdef", "cdef\n", "def\ng"] and r.n == [] and r.p == "Contextual Relevancy"


def test_golden_cases_are_strict(spark):
    good = {"case_id": "1", "url": "u", "question": "q", "expected_output": "e"}
    assert readers.golden_cases(spark, [good]).count() == 1
    for bad in ([], [{"case_id": "1"}], [good | {"arxiv_id": "x"}]):
        with pytest.raises(ValueError):
            readers.golden_cases(spark, bad)


def test_runs_and_repository(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs/run-1.json").write_text('{"run_id": "1", "cases": [{"case_id": "a", "status": "scored", "scores": {"m": 0.5}}]}')
    (tmp_path / "runs/run-2.json").write_text("{broken")
    assert [r.run_id for r in readers.newest_run(spark, f"{tmp_path}/runs").collect()] == ["1"]
    (tmp_path / "repo/sub").mkdir(parents=True)
    (tmp_path / "repo/a.txt").write_text("text é")
    (tmp_path / "repo/sub/b.bin").write_bytes(b"a\0b")
    (tmp_path / "repo/c.txt").write_bytes(b"\xff\xfe")
    assert [r.text for r in readers.repository(spark, f"{tmp_path}/repo").collect()] == ["text é"]


def test_snapshots(spark, tmp_path):
    readers.write_snapshot(spark.range(3), f"{tmp_path}/t", 1)
    readers.write_snapshot(spark.range(5), f"{tmp_path}/t", 2)
    assert readers.read_snapshot(spark, f"{tmp_path}/t").count() == 5


def test_replays_equal_loops(spark, data):
    events = sorted(streams._timed(spark, data).select("user_id", "at", "event_id", "event_type").collect(), key=lambda r: (r.user_id, r["at"], r.event_id))
    for query, step, empty, pick in ((streams.ttl_cache_replay, stateful.ttl_step, (None,), ["at"]), (streams.rate_limit_replay, stateful.leaky_step(1 / 3600, 2.0), (0.0, None), ["at"]), (streams.task_machine_replay, stateful.task_step, (None,) * 4, ["at", "event_type"])):
        want, state, last = {}, empty, None
        for r in events:
            if r.user_id != last:
                last, state = r.user_id, empty
            state, out = step(state, tuple(r[p] for p in pick))
            want[r.event_id] = tuple(out)
        assert {r[0]: tuple(r[1:]) for r in query(spark, data).collect()} == want


def test_stream_equals_batch(spark, data, tmp_path):
    events = streams._timed(spark, data).select("user_id", "at", "event_id", "event_type")
    events.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    out = stateful.streaming(stream, "user_id", ["at", "event_id"], ["at"], stateful.ttl_step, (None,), "status string", "started double")
    q = out.writeStream.format("memory").queryName("ttl_stream").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: r.status for r in spark.table("ttl_stream").collect()}
    assert got == {r.event_id: r.status for r in streams.ttl_cache_replay(spark, data).collect()}


def test_json_lines_drop_malformed(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"status": 200, "uri": "/a"}\nnot json\n{"status": 404, "uri": "/b"}\n')
    assert sorted(r.status for r in readers.json_lines(spark, str(tmp_path), "status int, uri string").collect()) == [200, 404]


def test_replies_and_references(spark):
    from docspark.operators import replies as A

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert tuple(one(A.structured_reply(lit('x {"answer": "a", "confidence": null} y')))) == ("a", None, "part")
    assert tuple(one(A.structured_reply(lit("{no")))) == ("{no", "low", "text")
    assert one(A.feedback(lit('```json\n{"status":"fail","feedback":"why"}\n```'))).feedback == "why"
    assert one(A.feedback(lit('["pass"]'))) is None
    assert tuple(one(A.verdict_pair(lit("oops")))) == (False, A.NO_VERDICT)
    assert tuple(one(A.first_artifact(lit("not json")))) == ("an invalid response", None)
    for raw, want in {"https://github.com/a/b.git": "a/b", "git@github.com:a/b.git": "a/b", "github.com/a/b/": "a/b", " a/b.git": "a/b", "a": None, "a/b/c": None, "a b/c": None}.items():
        assert one(A.repository(lit(raw))) == want
    assert one(A.between(lit("x Start: one two. End more STOP"), "start:", ["stop", "end"])) == "one two."
    assert one(A.between(lit("nothing"), "start:", ["stop"])) == "" and one(A.between(lit("start: all 😀 of it"), "start:", [])) == "all 😀 of it"
    assert one(A.with_sources(lit(" r "), F.array(lit("b"), lit("a"), lit("b"), lit("")))) == "r\n\n## Sources\n- b\n- a"
    assert one(A.with_sources(lit("r"), F.array().cast("array<string>"))) == "r"
    assert one(A.input_name(lit("Unnamed"), lit("the mask to use now"))) == "the mask to use input"
    blocks = lambda *b: F.array(*[F.struct(lit(p).alias("phase"), lit(t).alias("text")) for p, t in b])
    assert one(A.block_texts(blocks(("c", "x"), ("final_answer", "x"), ("final_answer", "y"), ("c", "")))) == "y"
    assert one(A.block_texts(blocks(("c", "x"), ("d", "y"), ("c", "x")))) == "x\n\ny"
    assert [s.title for s in one(A.sections(lit("<p>i</p><h2>A</h2>a<H2 id='x'>B</h2>b")))] == ["Overview", "A", "B"] and one(A.sections(lit("<p>no</p>"))) == []
    assert one(A.rejected_at(lit(10), lit(0))) == "input" and one(A.rejected_at(lit(90), lit(0))) == "output" and one(A.rejected_at(lit(90), lit(9))) is None


def test_cache_keys_keep_fields_apart(spark):
    from docspark.operators import caches

    row = spark.range(1).select(caches.key(a=F.lit("x|y"), b=F.lit("")).alias("p"), caches.key(b=F.lit("y|"), a=F.lit("x")).alias("q"), caches.key(b=F.lit(""), a=F.lit("x|y")).alias("r"), caches.key(a=F.lit(None).cast("string"), b=F.lit("")).alias("s")).first()
    assert row.p == row.r and len({row.p, row.q, row.s}) == 3


def test_search_modes_and_errors(spark, data):
    from docspark.operators import retrieval as R
    from docspark.plans import retrieval as plans

    args = plans._docs(spark, data), plans._vectors(spark, data), plans._query_vectors(spark, data)
    asks = plans._queries(spark, data).withColumn("use_hybrid", F.lit(True))
    got = R.search(asks, *args, size=3).collect()
    assert all(len(r.hits) <= 3 <= r.total for r in got if r["mode"] == "hybrid") and all([h["rank"] for h in r.hits] == list(range(1, len(r.hits) + 1)) for r in got)
    none = R.search(asks.withColumn("text", F.lit("zzzzzz")), *args, backend="keyword").collect()
    assert all(r.total == 0 and r.hits == [] for r in none)
    with pytest.raises(ValueError):
        R.search(asks, *args, backend="other")


def test_snapshot_of_a_failed_write_is_passed_over(spark, tmp_path):
    folder = str(tmp_path / "state")
    with pytest.raises(FileNotFoundError):
        readers.read_snapshot(spark, folder)
    for version in (2, 10):
        readers.write_snapshot(spark.range(version), folder, version)
    spark.range(11).write.parquet(f"{folder}/v=11")  # broke off before its commit
    assert readers.read_snapshot(spark, folder).count() == 10


def test_helpers_of_text_caches_and_tables(spark, tmp_path):
    from docspark.operators import caches

    rows = spark.createDataFrame([(1, " a, b,,c ", "123e4567-e89b-12d3-a456-426614174000", 2, ["x"]), (2, "", "no", 0, ["x"]), (3, None, None, 1, [])], "i long, csv string, id string, used int, sources array<string>")
    got = {r.i: (r.csv, r.uuid, r.cacheable) for r in rows.select("i", T.csv_list(F.col("csv")).alias("csv"), T.is_uuid(F.col("id")).alias("uuid"), caches.cacheable(F.col("used"), F.col("sources")).alias("cacheable")).collect()}
    assert got == {1: (["a", "b", "c"], True, True), 2: ([], False, False), 3: (None, None, False)}
    folder = str(tmp_path / "log")
    for n in (2, 3):
        readers.append_log(spark.range(n).coalesce(1), folder)
    assert tuple(store.table_stats(spark, folder).first()) == (5, 2)


def test_line_chunks_end_lines_as_splitlines_does(spark):
    rows = chunks.line_chunks(spark.createDataFrame([(1, "one\r\ntwo\x0bthree\u2028four\rfive")], "doc_id long, text string"), most=1, overlap=0).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.text) for r in rows] == [(i, i, t) for i, t in enumerate(["one", "two", "three", "four", "five"], 1)]
