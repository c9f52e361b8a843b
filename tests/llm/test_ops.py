from __future__ import annotations

import collections
import hashlib
import json
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docspark.llm import ann, bloomlm, chat, langid, minhash, mixing, packing, queries, rans, simhash, tokenfiles, tokens, warc
from docspark.llm.graphs import components
from docspark.llm.shingles import shingle_sets
from tests.oracle import check

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Documents also have columns with the names of working columns.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int, label string, row long, size int, key string, rank int"


def documents(rows: list[tuple], spark):
    return spark.createDataFrame([(i, t, l, s, len(t or ""), 0.5, 7, "x", 1, 2, "k", 3) for i, t, l, s in rows], SCHEMA)


def odd_rows() -> list[tuple]:
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ab", "co", "du", "éf", "gi") for b in ("ra", "ten", "lö", "mi", "po", "zu")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(60)
    near = base.split()
    near[7] = "other"
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", None), (4, None, None, "b"), (5, "", "en", "b"), (6, " \n\t ", "de", ""), (7, "one", "en", "a"), (8, "ONE", "fr", "c"), (9, "a b c d", "en", "c"),
            (10, say(20_000), "en", "a"), (11, "1234 ??", "en", "a"), (12, "x y z\u0085w  double  spaces \n mixed\x00nul don't", "en", "b"), (13, "日本語 テキスト 😀", "en", "b"), (14, "a <|endoftext|> b", "en", "b"), (2, base, "en", "a")]
    return rows + [(100 + i, say(rng.randrange(3, 400)), rng.choice(["en", "de"]), rng.choice(["a", "b", "c", None])) for i in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(odd_rows(), spark)


@pytest.fixture(scope="module")
def nothing(spark):
    return documents([], spark)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    check(spark, data, queries.queries()[name], queries.oracle_sql()[name])


# 1


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")


def test_ann_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [nan, 0.0, 1.0]), (7, [float("inf"), 0.0, 0.0]), (8, []), (9, [1.0, 2.0]), (100, [0.5, 0.5, 0.0]), (1, [1.0, 0.0, 0.0])]
    v = vectors(spark, rows)
    got = ann.search(v, v.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 1), (0, 3, 100), (0, 4, 2), (100, 1, 0), (100, 2, 1), (100, 3, 1), (100, 4, 2)]
    assert got[0].score == 0.0 and got[3].score == pytest.approx(2**0.5)
    assert ann.search(v.limit(0), v.limit(0)).count() == 0


def test_ann_repeated_ids_take_their_places(spark):
    rows = [(0, [1.0, 0.0]), *[(5, [1.0, 0.1])] * 12, *[(i, [1.0, 0.1 * i]) for i in range(6, 12)]]
    v = vectors(spark, rows)
    got = ann.search(v, v.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(i, 5) for i in range(1, 11)]
    tied = vectors(spark, [(0, [1.0, 0.0]), *[(i, [1.0, 1.0]) for i in range(30, 1, -1)]])
    assert [r.vec_id for r in ann.search(tied, tied.where("vec_id = 0")).orderBy("rank").collect()] == list(range(2, 12))


@pytest.mark.parametrize("spread", [0.15, 1.0])  # in clusters, and all over the place
def test_ann_cells_keep_recall(spark, monkeypatch, spread):
    monkeypatch.setattr(ann, "CELL_ROWS", 250)
    monkeypatch.setattr(ann, "CHUNK", 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 16))
    m = (centres[rng.integers(0, 20, 2000)] * (spread < 1) + spread * rng.standard_normal((2000, 16))).astype(np.float32)
    v = vectors(spark, [(i, x.tolist()) for i, x in enumerate(m)])
    got = ann.search(v, v.where("vec_id % 50 = 0")).toPandas()
    assert (got.groupby("query_id").size() == 10).all() and got["query_id"].nunique() == 40
    m, hits = m.astype(float), 0
    for q, g in got.groupby("query_id"):
        dist = np.sqrt(((m - m[q]) ** 2).sum(1))
        dist[q] = np.inf
        hits += len(set(np.lexsort((np.arange(2000), dist))[:10]) & set(g["vec_id"]))
        assert np.allclose(g["score"], dist[g["vec_id"]])
    assert hits >= 0.95 * len(got)
    probes = ann.fit_cells({16: m}, {16: 30}).probes[16]
    assert probes <= 6 if spread < 1 else probes > 6


def test_ann_recall_and_bounds(spark):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((1500, 40)).astype(np.float32)
    v = vectors(spark, [(i, x.tolist()) for i, x in enumerate(m)])
    got = ann.search(v, v.where("vec_id % 50 = 0")).toPandas()
    m = m.astype(float)
    hits = 0
    for q, g in got.groupby("query_id"):
        dist = np.sqrt(((m - m[q]) ** 2).sum(1))
        dist[q] = np.inf
        hits += len(set(np.lexsort((np.arange(1500), dist))[:10]) & set(g["vec_id"]))
        assert np.allclose(g["score"], dist[g["vec_id"]])
    assert hits >= 0.97 * len(got)
    packed, norm, align = ann.codes(m, m.mean(0), ann.rotation(40))
    guess, low = ann.bounds((m[3] - m.mean(0)) @ ann.rotation(40), packed, norm, align, ann.BOUND)
    true = ((m - m[3]) ** 2).sum(1)
    assert (low <= true + 1e-9).mean() > 0.99 and np.corrcoef(guess, true)[0, 1] > 0.8


# 2


def test_chat_links_orders_and_validates(spark):
    call = lambda i, name, args: {"id": i, "name": name, "arguments": args}
    says = lambda *calls: json.dumps({"tool_calls": list(calls)})
    tool = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    schemas = {"f": {"x": ("integer", True), "y": ("number", False), "o": ("object", False)}}
    rows = [
        (1, 0, "assistant", says(call("a", "f", {"y": 1, "x": 2}), call("b", "f", '{"x": 1, "o": {"$ref": "a"}}'))), (1, 1, "tool", tool("a", {"k": [1, None]})), (1, 2, "tool", tool("a", "late")),
        (1, 3, "assistant", says(call("c", "f", {"x": "s", "z": True, "o": {"$ref": "b"}}), call("a", "f", {}))), (1, 4, "tool", tool("q", 1)), (1, 4, "tool", tool("q", 1)),
        (2, 0, "assistant", says(call("a", "g", {"x": 1}), call("m", "f", {"x": 1, "o": {"$ref": "n"}}), call("n", "f", {"x": 1, "o": {"$ref": "m"}}), call(None, "f", "no json"))),
        (3, 0, "assistant", "plain {text"), (3, 1, "user", None), (None, 0, "assistant", says(call("a", "f", {"x": 1}))), (4, None, "assistant", None),
    ]
    m = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, level string")
    got = {(r.conv_id, r.turn, r.call_id): r for r in chat.link(m, schemas).collect()}
    assert len(got) == 10
    assert (got[1, 0, "a"].status, got[1, 0, "a"].level, got[1, 0, "a"].result_turn, got[1, 0, "a"].errors) == ("linked", 0, 1, "")
    assert got[1, 0, "a"].arguments_json == '{"x":2,"y":1}' and json.loads(got[1, 0, "a"].record)["result"] == {"k": [1, None]}
    assert (got[1, 0, "b"].level, got[1, 0, "b"].status) == (1, "no_result")
    assert (got[1, 3, "c"].level, got[1, 3, "c"].errors) == (2, "type:x,unexpected:z")
    assert (got[1, 3, "a"].status, got[1, 3, "a"].level, got[1, 3, "a"].errors) == ("duplicate", None, "missing:x")
    assert got[1, None, "q"].status == "orphan_result"
    assert got[2, 0, "a"].errors == "unknown tool" and got[2, 0, "m"].level is None and got[2, 0, "n"].level is None
    assert (got[2, 0, None].status, got[2, 0, None].errors) == ("no_id", "arguments are no object")
    assert got[None, 0, "a"].status == "no_id"
    assert list(json.loads(got[1, 0, "a"].record)) == sorted(json.loads(got[1, 0, "a"].record))
    assert chat.link(m.limit(0), schemas).count() == 0
    many = {f"tool{i}": {} for i in range(chat.LITERAL_TOOLS)} | schemas  # their schemas come as a table
    assert {(r.conv_id, r.turn, r.call_id): r for r in chat.link(m, many).collect()} == got


def test_chat_ties_and_results_without_a_key(spark):
    says = lambda x: json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": {"x": x}}]})
    rows = [(1, 0, "assistant", says(1)), (1, 0, "assistant", says(2)), (1, 0, "assistant", says(2) + " "), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": 5})),
            (1, 2, "tool", json.dumps({"content": 6})), (None, 2, "tool", json.dumps({"tool_call_id": "a", "content": 7})), (1, 3, "tool", "torn {"), (1, 4, "system", says(3))]
    for order in (rows, rows[::-1]):
        got = chat.link(spark.createDataFrame(order, "conv_id long, turn long, role string, text string"), {"f": {"x": ("integer", True)}}).collect()
        digest = lambda r: hashlib.sha256(r.arguments_json.encode()).hexdigest()
        calls = sorted((r for r in got if r.arguments_json), key=digest)
        assert [(r.status, r.level, r.result_turn) for r in calls] == [("linked", 0, 1), ("duplicate", None, None)]
        assert sorted((r.conv_id or 0, r.call_id or "", r.result_turn, r.status, json.loads(r.record)["result"]) for r in got if not r.arguments_json) == [(0, "a", 2, "no_id", 7), (1, "", 2, "no_id", 6)]


def test_chat_of_odd_conversations_equals_sql(spark, data, tmp_path):
    rows = [(None, 1, "assistant", "a"), (None, 2, "user", "b"), (3, None, "assistant", "c"), (3, None, "user", "d"), (None, None, "user", None), (5, 0, "system", "e"), (5, 1, "assistant", None), (5, 2, "user", None),
            (5, 2, "user", "f"), (5, 2, "assistant", "g"), (5, 2, "assistant", "h"), (5, 2, "assistant", "h"), (5, 3, "tool", "i"), (5, 4, "assistant", "j"), (5, 5, "user", "k"), (6, 1, "assistant", None), (7, 0, "assistant", None),
            (8, 1, "assistant", "l"), (9, 9, "user", "m"), (None, 1, "assistant", "a"), (None, 2, "user", "b"), (None, 4, None, "n")]
    for other in Path(data).glob("*.parquet"):
        if other.name != "conversations.parquet":
            (tmp_path / other.name).symlink_to(other)
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema), f"{tmp_path}/conversations.parquet")
    check(spark, str(tmp_path), queries.op2_tool_call_linking, chat.ORACLE)


def brute_levels(arcs: dict) -> dict:
    level: dict = {}
    while True:
        new = {v: max((level[u] + 1 for u in deps), default=0) for v, deps in arcs.items() if v not in level and all(u in level for u in deps)}
        if not new:
            return level
        level |= new


@pytest.mark.parametrize("shape", ["chain", "random", "cycles"])
def test_chat_levels_of_any_depth(spark, shape):
    rng = random.Random(6)
    if shape == "chain":
        arcs = {i: {i - 1} if i else set() for i in range(300)}
    elif shape == "random":
        arcs = {i: {rng.randrange(max(0, i - 12), i) for _ in range(rng.randrange(3))} if i else set() for i in range(80)}
    else:
        arcs = {0: {2}, 1: {0}, 2: {1}, 3: {2, 9}, 4: {3}, 5: {5}, 6: {9}, 9: set(), 7: {6, 9}, 8: {7, 4}, 10: {7, 6}}
    calls = spark.createDataFrame([(1, str(v)) for v in arcs], "conv_id long, call_id string")
    refers = spark.createDataFrame([(1, str(v), str(u)) for v, deps in arcs.items() for u in deps], "conv_id long, call_id string, dep string")
    assert {int(r.call_id): r.level for r in chat.levels(calls, refers).collect()} == brute_levels(arcs)


# 3


def test_warc_round_trip(spark):
    rows = [(5, "https://a/1", "<p>é</p>"), (3, "https://a/2", "<p>é</p>"), (9, None, "<p>é</p>"), (1, "https://a/3\r\nX: y", None), (2, "u", ""), (4, "v", "z" * 200_000), (None, "w", "alone"), (4, "v", "z" * 200_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(map(tuple, warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    ids: dict = {}
    for i, _, h in rows:
        if i is not None:
            ids[h or ""] = min(i, ids.get(h or "", i))
    import base64

    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        refers = ids[h or ""] if i is not None and ids[h or ""] != i else None
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if refers is None else "revisit", refers))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reads_only_what_is_selected(spark):
    pages = spark.createDataFrame([(i, f"https://h/{i}", f"<p>{i}</p>" * 500) for i in range(200)], "page_id long, url string, html string")
    index = warc.archive(pages)
    few = warc.lookup(index, spark.createDataFrame([("https://h/7",), ("https://h/8",), ("https://h/150",)], "url string")).collect()
    assert {r.page_id: bytes(r.payload) for r in few} == {i: (f"<p>{i}</p>" * 500).encode() for i in (7, 8, 150)}
    assert warc.byte_ranges(index, gap=0).count() < 50


# 4, 7


def all_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_batch_tokenizer_equals_library():
    texts = [r[1] for r in odd_rows()] + ["<|endoftext|> x", "a<|endoftext|>", "it's 'll o'clock x'y", "１２ ３", "tab\t\tx", " lead", "trail ", "a b c  d"]
    ids, n = tokens.batch_tokenizer(tokens.tokenizer_path(), plain=False).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == all_ids(texts)
    assert tokens.batch_tokenizer(tokens.tokenizer_path()).encode(pa.array([], pa.string()))[1].tolist() == []


def test_added_tokens_as_the_unmodified_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.tokenizer_path())
    texts = ["a<|endoftext|> x", "<|endoftext|>", "a  <|endoftext|>", "x<|endoftext|><|endoftext|>y", "a <|endoftext| b", "no such token"]
    ids, n = tokens.BatchTokenizer(tokens.tokenizer_path()).encode(pa.array(texts))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
    few = documents([(i, t, "en", "a") for i, t in enumerate(texts)], spark)
    crc = lambda end: [zlib.crc32(np.array([*w, end], "<u4").tobytes()) for w in want]
    assert [r[3] for r in sorted(map(tuple, tokenfiles.round_trip(few).collect()))] == crc(0)
    assert [r.ids_crc32 for r in packing.packed_documents(few).orderBy("doc_id").collect()] == crc(2)


def test_packing(spark, docs, nothing, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 16)
    got = packing.packed_documents(docs).toPandas()
    rows = odd_rows()
    want = collections.Counter()
    total = 0
    for (i, *_), ids in zip(rows, all_ids([r[1] for r in rows]), strict=True):
        ids = np.array([*ids, 2], "<u4")
        total += len(ids)
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 1024 and g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist()
    assert got["sequence_id"].nunique() <= -(-total // 1024) + 3
    assert packing.packed_documents(nothing).count() == 0


def test_genetic_packing_is_whole_and_tight():
    rng = np.random.default_rng(4)
    for lengths in ([], [5], [600] * 9, rng.integers(1, 1024, 900).tolist(), [512] * 40 + [256] * 80):
        bins = packing.evolve(lengths, 1024, [], (1, 2)) if lengths else []
        assert sorted(x for b in bins for x in b) == list(range(len(lengths)))
        assert all(sum(lengths[x] for x in b) <= 1024 for b in bins)
        assert len(bins) <= len(packing.best_fit(list(range(len(lengths))), lengths, 1024, []))
    lengths = rng.integers(1, 700, 200).tolist()
    one, two = packing.best_fit(list(range(200)), lengths, 1024, []), packing.best_fit(list(range(100)), lengths, 1024, packing.best_fit(list(range(100, 200)), lengths, 1024, []))
    child = packing.crossover(one, two, lengths, 1024, rng)
    assert sorted(x for b in child for x in b) == list(range(200))
    assert any(b in child for b in two)


def test_search_beats_best_fit():
    rng = np.random.default_rng(8)
    better = 0
    for _ in range(4):
        lengths: list[int] = []
        for _ in range(30):  # thirty sequences that three pieces fill
            a = int(rng.integers(390, 510))
            b = int(rng.integers(250, (1024 - a) // 2 + 1))
            lengths += [a, b, 1024 - a - b]
        plain = len(packing.best_fit(list(range(90)), lengths, 1024, []))
        found = packing.evolve(lengths, 1024, [], (1, 2), generations=40)
        assert sorted(x for b in found for x in b) == list(range(90)) and all(sum(lengths[x] for x in b) <= 1024 for b in found)
        better += plain - len(found)
        assert len(found) <= plain
    assert better >= 2
    bins = [[0, 1]]
    assert packing.replace([2], [500, 300, 520], 1024, bins) == [1] and sorted(bins[0]) == [0, 2]


def test_islands_keep_their_elite(spark):
    lengths = np.random.default_rng(5).integers(100, 900, 60).tolist()
    items = spark.createDataFrame([(0, k, n) for k, n in enumerate(lengths)], "shard long, key long, length int")
    counts = [packing._solve(items, 1024, e, 2).groupBy("bin").count().count() for e in (1, 3)]
    assert counts[1] <= counts[0] <= len(packing.best_fit(list(range(60)), lengths, 1024, []))


def test_rans_round_trips():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 2049, 300_000):
        ids = (rng.zipf(1.3, n) % 5000).astype(np.uint32)
        table = rans.Table(rans.scaled(np.bincount(ids, minlength=5001)))
        data = rans.encode(ids, table)
        assert (rans.decode(data, table) == ids).all()
        if n:
            assert (np.concatenate([rans.decode(data, table, k) for k in range(rans.segments(data))]) == ids).all()
            assert int(table.freq.sum()) == 1 << rans.SCALE_BITS
    broken = bytearray(data)
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(broken), table)


def test_token_files(spark, docs, nothing, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BUCKET_ROWS", 10)
    monkeypatch.setattr(tokenfiles, "BLOCK_IDS", 2000)
    got = tokenfiles.round_trip(docs).collect()
    rows = sorted(odd_rows(), key=lambda r: r[0])
    at, want = 0, []
    for (i, *_), ids in zip(rows, all_ids([r[1] for r in rows]), strict=True):
        ids = np.array([*ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got)) == want
    assert tokenfiles.round_trip(nothing).count() == 0


# 5


def word_sets(rows):
    out: dict[int, set] = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        s = set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()
        out[i] = out.get(i, set()) | s
    return out


def brute_components(sets, percent=75):
    ids = sorted(sets)
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_rows():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for n in (6, 30, 150):
        for _ in range(3):
            base = [rng.choice(words) for _ in range(n)]
            for edits in (0, 0, 1, 1, 2, 3, n // 12, n // 8, n // 4):
                t = list(base)
                for _ in range(edits):
                    t[rng.randrange(n)] = "EDIT" + rng.choice(words)
                rows.append((k, " ".join(t), "en", "s"))
                k += 1
    return rows


def test_near_duplicates_equal_brute_force(spark, docs, nothing, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    for rows in (near_rows(), odd_rows()):
        sets = word_sets(rows)
        want = brute_components(sets)
        got = minhash.near_duplicates(documents(rows, spark)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(sets[r.doc_id]), r.doc_id == want[r.doc_id])
    assert minhash.near_duplicates(nothing).count() == 0
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({v for v in brute_components(word_sets(odd_rows())).values()})


def test_deduplicated_decides_by_row(spark):
    say = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [
        (None, say("a"), "en", "s"), (None, say("b"), "en", "s"), (None, say("b") + " end", "en", "s"), (None, "", "en", "s"), (None, None, "en", "s"),  # null ids
        (5, say("c"), "en", "s"), (5, say("d"), "en", "t"), (5, say("d"), "en", "r"), (5, "", "en", "s"), (5, "", "en", "s"),  # one id, several texts
        (9, say("e"), "en", "s"), (None, say("e"), "en", "s"), (3, say("e") + " end", "en", "s"),  # a null id comes last
    ]
    want, stays = [rows[i] for i in (0, 3, 4, 5, 7, 8, 12)], []
    for order in (rows, rows[::-1]):
        got = [(r.doc_id, r.text, r.lang, r.source) for r in minhash.deduplicated(documents(order, spark)).collect()]
        rest = [r for r in got if r[1] not in (say("b"), say("b") + " end")]
        assert sorted(r[:3] for r in rest if r[0] is not None) == sorted(r[:3] for r in want if r[0] is not None)
        assert sorted((str(r[1]) for r in rest if r[0] is None)) == sorted(str(r[1]) for r in want if r[0] is None)
        assert len(got) == len(want) + 1
        stays.append({r for r in got if r[1] == say("d")})
    assert stays[0] == stays[1]


def test_large_near_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.randrange(8)):
            t[rng.randrange(120)] = f"e{rng.randrange(1000)}"
        rows.append((i, " ".join(t), "en", "s"))
    want = brute_components(word_sets(rows))
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(rows, spark)).collect()} == want


def test_estimates_follow_similarity():
    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for keep in (1000, 800, 500, 0):
        b = np.concatenate((a[:keep], np.arange(5000, 6000 - keep, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        x, y = minhash.planes([minhash.pack(minhash.minima(s)) for s in (a, b)])
        assert abs(float(minhash.estimate(x, y)) - keep / (2000 - keep)) < 0.2


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(5, 5), (6, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}}


def test_shingle_sets_sizes():
    assert [len(s) for s in shingle_sets(pa.array(["a b c d e f", "A b C d e", "a", "", None, " \t", "a a a a a a a"]))] == [2, 1, 1, 0, 0, 0, 1]


# 6


def test_simhash_report(spark, docs, nothing, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 7)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 3)
    got = simhash.report_with_links(docs, lambda f: f.cache()).toPandas()
    rows = sorted(odd_rows(), key=lambda r: (-r[0], r[1] or ""))
    assert len(got) == len(rows)
    fps = np.array([int(x, 16) for x in got["fingerprint"]], np.uint64)
    seen = collections.Counter()
    for k, (i, t, *_) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 3
        seen[i, len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()] += 1
    assert collections.Counter(got[["doc_id", "n_chars", "edited_sha256"]].itertuples(index=False, name=None)) == seen
    near = [(np.bitwise_count(fps ^ f) <= simhash.RADIUS).sum() - 1 for f in fps]
    assert got["n_within"].tolist() == near
    assert got[got["doc_id"].isin([1, 2])]["fingerprint"].nunique() == 1
    assert got["near_edited"].between(0, 1).all() and got["near_next"].between(0, 1).all()
    assert simhash.fingerprint_report(nothing).count() == 0


def test_hot_ids_are_split_in_order(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 50)
    rows = [(None if i % 3 == 0 else 400 if i % 3 == 1 else i, f"text {i} of {i % 7}") for i in range(1500)] + [(None, "")] * 3 + [(1, "same")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = simhash.hash_buckets(simhash.range_buckets(docs, "doc_id", 50).withColumn("h", F.xxhash64("text"))).collect()
    assert max(collections.Counter(r.bucket for r in placed).values()) <= 100
    order = [(r.doc_id, r.h) for r in sorted(placed, key=lambda r: (-r.bucket, r.doc_id is None, -(r.doc_id or 0), r.h))]
    want = sorted(((r.doc_id, r.h) for r in placed), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert order == want
    texts = {}
    for r in placed:
        texts.setdefault((r.doc_id, r.h), r.text)
    turned = collections.Counter((r.doc_id, r.text, r.next_id, r.next_text) for r in simhash.in_turn(docs).collect())
    assert turned == collections.Counter((i, texts[i, h], j, texts[j, k]) for (i, h), (j, k) in zip(want, want[1:] + want[:1], strict=True))


def plain_fingerprint(text: str) -> int:
    """Votes counted one by one over the words of the text."""
    import xxhash

    def mix(x: int) -> int:
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ (x >> 33)) * m) & (2**64 - 1)
        return x ^ (x >> 33)

    w = [xxhash.xxh3_64_intdigest(x) for x in WORD.findall(text.translate(LOWER))]
    terms = collections.Counter([mix((a * 0x9E3779B97F4A7C15 + b) % 2**64) for a, b in zip(w, w[1:], strict=False)] if len(w) > 1 else [mix(x) for x in w])
    votes = [sum(round(64 * (1 + np.log(n))) * (1 if t >> k & 1 else -1) for t, n in terms.items()) for k in range(64)]
    return sum(1 << k for k, v in enumerate(votes) if v > 0)


def test_fingerprints_are_votes(spark, docs):
    rows = sorted(odd_rows(), key=lambda r: (-r[0], r[1] or ""))
    got = {(r.doc_id, r.n_chars): r for r in simhash.fingerprint_report(docs).collect()}
    bits = lambda x, y: 1 - (x ^ y).bit_count() / 64
    for k, (i, t, *_) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        r, fp, fe, fn = got[i, len(t)], *map(plain_fingerprint, (t, edited, nxt))
        assert (r.fingerprint, r.edited_fingerprint) == (f"{fp:016x}", f"{fe:016x}")
        assert r.near_edited == pytest.approx(bits(fp, fe)) and r.near_next == pytest.approx(bits(fp, fn))


def test_radius_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (0, 0, 1, 2, 3, 4, 5)])
    got = simhash.within_radius(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()
    for r in got:
        d = np.bitwise_count(fps ^ np.array([r.fp], np.int64).view(np.uint64)[0])
        assert (r.copies, r.near) == ((d == 0).sum(), ((d > 0) & (d <= simhash.RADIUS)).sum())


# 8


def test_language_model_scores(spark, docs, nothing):
    rows = odd_rows()
    toks = [(i, [*WORD.findall((t or "").translate(LOWER)), None], zlib.crc32(str(i).encode()) % 5 == 1) for i, t, *_ in rows]
    c = collections.Counter(w for _, ws, held in toks if not held for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i, held, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws, held in toks)
    for most in (bloomlm.BROADCAST_WORDS, 0):
        got = bloomlm.scores(docs, most).collect()
        assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert bloomlm.scores(nothing).count() == 0


def plain_scores(rows):
    """The model with exact counts in place of the filter."""
    toks = {k: [*WORD.findall((r[1] or "").translate(LOWER)), None] for k, r in enumerate(rows)}
    train = [toks[k] for k, r in enumerate(rows) if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    one = collections.Counter(w for t in train for w in t)
    two = collections.Counter(p for t in train for p in zip(["start", *t], t, strict=False))

    def quantised(c: int) -> float:
        if not c:
            return 0.0
        level = 1 + int(np.floor(np.log(c) / np.log(1.5) + 1e-9))
        return float(level) if level <= 2 else (1.5 ** (level - 1) + 1.5**level) / 2

    n, v = sum(one.values()), len(one)
    unseen = min(0.99, max(0.01, sum(c == 1 for c in two.values()) / sum(two.values())))
    out = []
    for t in toks.values():
        total = 0.0
        for k, (a, b) in enumerate(zip(["start", *t], t, strict=False)):
            context = len(train) if k == 0 else quantised(one[a])
            both = quantised(two[a, b])
            weight = 1 - unseen if context > 0 else 0.0
            total += np.log10(weight * min(1.0, both / max(context, both, 1)) + (1 - weight) * (quantised(one[b]) + 0.5) / (n + 0.5 * (v + 1)))
        out.append(total)
    return out


def test_scores_equal_the_model_with_exact_counts(spark):
    rows = [(i, t, lang, s) for i, (_, t, lang, s) in enumerate(odd_rows())]
    want = plain_scores(rows)
    got = {r.doc_id: r for r in bloomlm.scores(documents(rows, spark)).collect()}
    off = [abs(got[i].score - want[i]) / got[i].n_tokens for i in got]
    assert np.mean(np.array(off) < 1e-9) > 0.4 and max(off) < 0.02  # the filter's rare false answers only


def test_learnt_texts_score_above_held_out_ones(spark, data):
    real = spark.read.parquet(f"{data}/documents.parquet")
    got = bloomlm.scores(real).where("n_tokens > 20").withColumn("per", F.col("score") / F.col("n_tokens")).groupBy("held_out").agg(F.avg("per").alias("m")).collect()
    mean = {r.held_out: r.m for r in got}
    assert mean[False] > mean[True]


def test_filter_levels_never_fall_short():
    rng = np.random.default_rng(3)
    grams = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    counts = rng.zipf(1.5, len(grams)).clip(1, 10**6)
    size = int(bloomlm.levels(counts).sum() * bloomlm.BITS_EACH)
    bits = np.frombuffer(bloomlm.segment_bits(grams, counts, size) + b"\0", np.uint8)
    lm = bloomlm.LogFrequencyFilter(1, np.array([[0], [size]]), np.zeros((2, 1), np.int64), [bits], 1, 1, 0.5, 1)
    got = lm.level(grams, 2)
    assert (got >= bloomlm.levels(counts)).all() and (got == bloomlm.levels(counts)).mean() > 0.97
    assert (lm.level(rng.integers(0, 1 << 63, 4000, dtype=np.uint64), 2) > 0).mean() < 0.03


def test_scores_keep_their_bits_beyond_the_mapped_size(spark, docs, monkeypatch):
    more = documents([(7_000_000_000_000_000_001, "one two", "en", "a"), (None, "two three", "en", "a")], spark).unionByName(docs)
    ordered = lambda rows: sorted(map(tuple, rows), key=str)
    want = ordered(bloomlm.scores(more).collect())
    for name in ("MOST_BITS", "MAPPED_BITS"):
        monkeypatch.setattr(bloomlm, name, 100, raising=False)
    got = ordered(bloomlm.scores(more).collect())
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], atol=1e-9)


# 9


def test_mix_hits_targets(spark, docs, nothing):
    got = mixing.taken(docs, block_words=64, shard_words=1000).toPandas()
    rows = odd_rows()
    assert len(got) == len(rows)
    assert sorted(got["size"]) == sorted(len(WORD.findall(t or "")) for _, t, *_ in rows)
    by = {s: sum(len(WORD.findall(t or "")) for _, t, _, x in rows if x == s) for s in {r[3] for r in rows}}
    names = sorted([s for s in by if s is not None]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, total, target = set(names), 1.5 * sum(by.values()), {}
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > 2 * by[s]}
        if not over:
            break
        target |= {s: 2.0 * by[s] for s in over}
        left -= over
    target |= {s: weight[s] * level for s in left}
    own = {i: s for i, _, _, s in rows}
    got["source"] = got["doc_id"].map(lambda i: "<null>" if own[i] is None else own[i])
    for s, g in got.groupby("source"):
        s = None if s == "<null>" else s
        assert np.allclose(g["target"], target[s]) and (g["source_size"] == by[s]).all()
        assert abs(g["taken"].sum() - target[s]) <= 1 and (g["taken"] <= 2 * g["size"]).all()
    again = mixing.taken(docs, block_words=64, shard_words=1000).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(got[key].itertuples(index=False, name=None)) == sorted(again[key].itertuples(index=False, name=None))
    assert mixing.taken(nothing).count() == 0
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns and whole.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 8


def test_mixed_texts_are_what_the_mix_takes(spark):
    rng = random.Random(3)
    rows = [(i, " " * (i % 2) + " \t".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 90))) + "\n" * (i % 3), "en", "abc"[i % 3]) for i in range(60)] + [(7, None, "en", "a"), (8, "", "en", None), (None, "x y z", "en", None)]
    docs = documents(rows, spark)
    took = mixing.taken(docs, block_words=16, shard_words=200)
    words = sum(len(WORD.findall(r.text)) for r in mixing.mixed_documents(docs, block_words=16, shard_words=200).collect())
    assert words == took.agg(F.sum("taken")).first()[0]
    cut = spark.createDataFrame([(" a  b\tc d ", 2), ("a b c", 1)], "t string, n int").select(mixing.first_words(F.col("t"), F.col("n")).alias("x")).collect()
    assert [r.x for r in cut] == [" a  b\t", "a "]


def test_taken_words_come_from_the_leaves(spark, docs, monkeypatch):
    shards, placed = mixing.mix(docs, block_words=64, shard_words=1000)
    got = shards.toPandas()
    assert got["shard"].nunique() > 3 and placed.count() == len(odd_rows())
    for _, g in got.groupby("shard"):
        assert not g["block"].is_monotonic_increasing  # shuffled inside the shard
    whole = mixing.taken(docs, block_words=64, shard_words=1000).agg(F.sum("taken")).first()[0]
    full = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda *a: full(*a).where("shard <> 1"))
    less = mixing.taken(docs, block_words=64, shard_words=1000).agg(F.sum("taken")).first()[0]
    assert less == whole - got[got["shard"] == 1]["words"].sum() < whole


def test_mixing_copies_and_blocks_that_grow(spark, docs, monkeypatch):
    say = " ".join(f"w{i}" for i in range(30))
    copies = documents([(1, say, "en", "a")] * 5 + [(2, say, "en", "b")], spark)
    got = sorted((r.doc_id, r.taken) for r in mixing.taken(copies, block_words=8, shard_words=64).collect())
    assert [i for i, _ in got] == [1] * 5 + [2] and abs(sum(t for _, t in got) - 270) <= 1 and all(t <= 60 for _, t in got)
    want = sorted(map(tuple, mixing.taken(docs, block_words=64).drop("first_shard").collect()), key=str)
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 30)
    assert sorted(map(tuple, mixing.taken(docs, block_words=64).drop("first_shard").collect()), key=str) == want


def test_rows_without_an_id_are_spread(spark):
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"w{i} word", "en", "a") for i in range(3000)]
    placed = [r.asDict() for r in mixing.permuted(mixing.word_sizes(documents(rows, spark)), 17).collect()]
    assert sorted(r["first"] for r in placed) == list(range(0, 6000, 2))
    third = [sum(1 for r in placed if r["doc_id"] is None and r["first"] // 1000 == k) for k in range(6)]
    assert sum(third) == 1000 and max(third) <= 2 * min(third)
    again = mixing.taken(documents(rows[::-1], spark), block_words=16).select("doc_id", "size", "taken")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, mixing.taken(documents(rows, spark), block_words=16).select("doc_id", "size", "taken").collect()), key=str)


def test_splitting_tree_is_exact():
    quotas = np.array([17, 0, 5, 101])
    seen = [set() for _ in quotas]
    sizes = []
    for shard in range(7):
        first, n = mixing._path(shard, 7, quotas, 3)
        sizes.append(int(n.sum()))
        for s, (a, k) in enumerate(zip(first, n, strict=True)):
            blocks = set(range(a, a + k))
            assert not blocks & seen[s]
            seen[s] |= blocks
    assert [len(x) for x in seen] == quotas.tolist() and max(sizes) - min(sizes) <= 3


# 10


def test_languages(spark, data, docs, nothing):
    real = spark.read.parquet(f"{data}/documents.parquet")
    got = langid.language_report(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95
    rows = {r.doc_id: r for r in langid.language_report(docs).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (4, 5, 6, 11))
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in rows)
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert langid.language_report(nothing).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and not {4, 5, 6, 11} & {r.doc_id for r in kept.collect()}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_report(unlabelled).collect()} == {"und"}


def plain_language(texts_by_lang, text):
    """The same decision with sets in place of filters."""
    def of(t):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in t)
        low = "".join(c if c.isalpha() else "\0" for c in low)
        return [("\0" + low + "\0")[i : i + 3] for i in range(len(low)) if low[i] != "\0"]

    counts = {lang: collections.Counter(g for t in ts for g in of(t)) for lang, ts in texts_by_lang.items()}
    share = {lang: {g: n / c.total() for g, n in c.items()} for lang, c in counts.items()}
    most = collections.defaultdict(float)
    for s in share.values():
        for g, x in s.items():
            most[g] = max(most[g], x)
    has = {lang: {g for g, x in s.items() if x >= langid.KEEP_SHARE * most[g]} for lang, s in share.items()}
    mine = of(text)
    if not mine:
        return "und", 0.0
    hits = sorted(((sum(g in h for g in mine), lang) for lang, h in has.items()), key=lambda x: (-x[0], x[1]))
    return hits[0][1], 0.5 * hits[0][0] / len(mine) + 0.5 * (hits[0][0] - hits[1][0]) / max(hits[0][0], 1e-9)


def test_languages_equal_sets(spark, data, monkeypatch):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r.lang]
    monkeypatch.setattr(langid, "PIECE", 700)
    learnt = collections.defaultdict(list)
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            learnt[lang].append(t or "")
    rows = rows[:60]
    model = langid.fit(spark, spark.createDataFrame([(lang, t) for lang, ts in learnt.items() for t in ts], "lang string, text string"))
    got, score = model.predict(pa.array([t for _, t, _ in rows]))
    for (_, t, _), lang, x in zip(rows, got, score.tolist(), strict=True):
        want, near = plain_language(learnt, t or "")
        assert lang == want and abs(x - near) < 0.02


def test_more_languages_than_a_word_has_bits(spark, monkeypatch):
    rng = random.Random(2)
    say = lambda k, n: " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) + chr(0x3B1 + k % 20) + chr(0x430 + k // 20) for _ in range(n))
    rows = [(i, say(i % 70, 40), f"l{i % 70:02d}", "s") for i in range(280)]
    want = {i: lang for i, _, lang, _ in rows}
    monkeypatch.setattr(langid, "FILE_SLOTS", 1 << 14)
    got = langid.language_report(documents(rows, spark)).collect()
    assert sum(want[r.doc_id] == r.lang_pred for r in got) >= 0.97 * len(got)


def test_long_texts_are_read_whole(spark):
    text = "ab 日本😀x Cd-e " * 40_000
    small = list(langid.grams(pa.array(["", text[:30], None, text])))
    keys, row = (np.concatenate([p[k] for p in small]) for k in (0, 1))
    once = np.concatenate([k for k, _ in langid.grams(pa.array([text[:13]]))])
    assert len(small) > 1 and (row == 3).sum() == 40_000 * len(once) and set(keys[row == 3].tolist()) == set(once.tolist())


FRESH = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.python.worker.reuse", "false").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from docspark.llm import langid
docs = spark.read.parquet({data!r})
print("rows", langid.language_report(docs.limit(50)).count(), langid.keep_identified(docs.limit(50)).count() > 0)
"""


def test_languages_in_fresh_workers(data):
    import pathlib
    import subprocess
    import sys

    code = FRESH.format(repo=str(pathlib.Path(__file__).parents[2]), data=f"{data}/documents.parquet")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "rows 50 True" in out.stdout, out.stderr[-2000:]
