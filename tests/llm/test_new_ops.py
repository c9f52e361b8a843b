from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docspark.llm import merkle, pieces, resample
from tests.llm.test_ops import LOWER, documents, odd_rows


@pytest.fixture(scope="module")
def docs(spark):
    more = [(None, "null id", "en", "a"), (None, "null id", "en", "a"), (None, None, None, None), (-5, "minus", "fr", "a"), (2**62, "far away", "de", "b")]
    return documents(odd_rows() + more, spark)


@pytest.fixture(scope="module")
def nothing(spark):
    return documents([], spark)


# 11

FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text: str | None, longest: int) -> list[str]:
    words = FEATURE.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute_resampled(rows: list, target: list[str | None], share: int, least: int, longest: int, buckets: int) -> list[tuple]:
    own = [[zlib.crc32(f.encode()) % buckets for f in features(t, longest)] for _, t in rows]
    wanted = [zlib.crc32(f.encode()) % buckets for t in target for f in features(t, longest)]
    s, t = [0] * buckets, [0] * buckets
    for b in (b for x in own for b in x):
        s[b] += 1
    for b in wanted:
        t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for (i, text), codes in zip(rows, own, strict=True):
        weight = sum(gain[b] for b in codes) // len(codes) if codes else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(codes), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(features(text, 1))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: len(able) * share // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize(("share", "least", "longest"), [(10, 20, 1), (100, 1, 1), (60, 0, 3)])
def test_resampling_equals_brute_force(spark, docs, share, least, longest):
    target = spark.createDataFrame([(1, "One a b c d"), (2, None), (3, "")], "item_id long, text string")
    got = resample.resampled(docs, target, share, least, longest, buckets=500).collect()
    want = brute_resampled([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], ["One a b c d", None, ""], share, least, longest, 500)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_resampling_of_nothing(spark, nothing, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert resample.resampled(nothing, empty).count() == 0
    assert resample.resampled(docs, empty).count() == docs.count()


def test_radix_sort_is_stable_and_keeps_parts_even(spark, monkeypatch):
    monkeypatch.setattr(resample, "PART_ROWS", 16)
    rng = random.Random(3)
    values = [(rng.choice([7, 7, 7, -(2**63), 2**63 - 1, rng.randrange(-50, 50)]), rng.randrange(3), i) for i in range(700)]
    rows = spark.createDataFrame(values, "a long, b long, c long").repartition(5, "c")
    first = [tuple(r) for r in rows.collect()]
    got = resample.radix_ranked(rows, [F.col("a"), F.bitwise_not("b")], width=5).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(700))
    assert [(r.a, r.b, r.c) for r in got] == sorted(first, key=lambda r: (r[0], -r[1]))
    one = resample.counting_pass(resample.materialize(rows.withColumn("pos", F.monotonically_increasing_id()), "t").withColumn("part", F.shiftright("pos", 33)), F.lit(0), 16)
    assert one.groupBy("part").count().agg(F.max("count")).first()[0] == 16


# 12


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def hard_texts() -> list[str]:
    rng = random.Random(1)
    letters = " ▁abeth  éßñ日本\t\n\x00😀한٣<0x41>"
    some = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2000)]
    spaces = [" " * k for k in range(70)] + ["x" + " " * k + "y" for k in range(70)]
    return some + spaces + ["</s> <s>a<unk>", "", "abc" * 3000, "a" + " " * 1000 + "日" * 400, "　ﬁ Å", "und so weiter " * 5000]


def test_pieces_equal_the_library(library):
    own, texts = pieces.PieceCodec(pieces.model_path()), hard_texts()
    ids, n = own.encode(pa.array(texts))
    want = library.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
    assert own.decode(ids, n) == library.decode(want)


def test_decoding_of_any_ids_equals_the_library(library):
    rng = random.Random(2)
    lists = [[rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(12))] for _ in range(5000)]
    own = pieces.PieceCodec(pieces.model_path())
    assert own.decode(np.array(sum(lists, [])), np.array([len(x) for x in lists])) == [library.decode(x) for x in lists]


def test_one_token_is_compatible_with_each_prefix(library):
    """The table's claim: of all pieces that end at a place just one goes with the last token before it, and it is the library's."""
    table = pieces.PieceCodec(pieces.model_path()).table
    for word in ("▁internationalisation", "▁▁▁▁▁", "▁Straßenbahnen", "▁aaaaaaaaaaaaaa", "▁日本語テキスト"):
        last = [table.none]
        for end in range(1, len(word) + 1):
            ending = [i for p, i in table.model.ids.items() if word[:end].endswith(p)]
            good = [i for i in ending if table.compatible(last[end - len(table.model.pieces[i])], i)]
            assert len(good) == 1
            last += good
        assert last[-1] == library.encode(word[1:].replace("▁", " "))[-1]


def test_pieces_of_documents(spark, docs, nothing, library):
    path = pieces.model_path()
    rows = pieces.decoded(pieces.encoded(docs, path), path).collect()
    want = {(r.doc_id, tuple(ids), library.decode(ids)) for r in docs.collect() for ids in [library.encode(r.text or "")]}
    assert len(rows) == docs.count() and {(r.doc_id, tuple(r.ids), r.text) for r in rows} == want
    got = pieces.digests(pieces.decoded(pieces.encoded(docs.where("doc_id = 13"), path), path)).first()
    ids = library.encode("日本語 テキスト 😀")
    assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256("日本語 テキスト 😀".encode()).hexdigest())
    assert pieces.digests(pieces.decoded(pieces.encoded(nothing, path), path)).count() == 0


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "PAIRS", 50)
    monkeypatch.setattr(pieces, "PAIR_BITS", 4)
    monkeypatch.setattr(pieces, "WORD_BYTES", 1000)
    monkeypatch.setattr(pieces, "LONG", 5)
    own, texts = pieces.PieceCodec(pieces.model_path()), hard_texts()[:300]
    for i in range(0, 300, 50):
        ids, n = own.encode(pa.array(texts[i : i + 50]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == library.encode(texts[i : i + 50])


# 13


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows: list) -> list[tuple]:
    def leaf(r, more: int = 0) -> str:
        cells = [r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text]
        return sha(*("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))

    def proofs(digests: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
        row, at, out = digests, list(range(len(digests))), [[] for _ in digests]
        while len(row) > 1:
            for i, a in enumerate(at):
                out[i].append((row[a - 1] if a % 2 else "", row[a + 1] if a % 2 == 0 and a + 1 < len(row) else ""))
            row, at = [sha(*row[i : i + 2]) for i in range(0, len(row), 2)], [a // 2 for a in at]
        return row[0], out

    langs: dict = {}
    for r in rows:
        langs.setdefault(r.lang, []).append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs.values():
        x.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    trees = {k: proofs([leaf(r) for r in langs[k]]) for k in names}
    root, upper = proofs([trees[k][0] for k in names])
    out = []
    for k, up in zip(names, upper, strict=True):
        for r, own in zip(langs[k], trees[k][1], strict=True):
            changed = r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            fold = leaf(r, int(changed))
            for left, right in own + up:
                fold = sha(left, fold, right)
            out.append((r.doc_id, leaf(r), trees[k][0], root, sha(*(x for pair in own + up for x in pair)), fold, fold == root))
    return out


def by_text(rows) -> list:
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("levels", [10, 2])
def test_manifest_equals_brute_force(spark, docs, levels):
    odd = docs.unionByName(docs.limit(3).withColumns({"n_chars": F.lit(None).cast("long"), "lang": F.concat(F.lit("x"), "doc_id")}))
    assert by_text(merkle.report(odd, levels=levels).collect()) == by_text(brute_manifest(odd.collect()))


def test_versions_share_what_they_do_not_change(spark, docs):
    tree = merkle.PathCopyTree([sha(str(i)) for i in range(13)], merkle.height(13))
    nodes, first = len(tree.digest), list(tree.digest)
    added = tree.change(12, sha("x"))
    assert len(added) == tree.height + 1 and tree.digest[:nodes] == first
    assert merkle.climb(sha("x"), merkle.steps(tree.path(12)))[-1] == tree.digest[tree.roots[-1]] != tree.digest[tree.roots[0]]
    below = {k for i in added[1:] for k in tree.kids[i]}
    assert len(below - set(added)) == sum(len(tree.kids[i]) - 1 for i in added[1:])
    for r in merkle.manifest(docs, levels=3).collect():
        assert merkle.climb(r.leaf, merkle.steps(r.proof))[-1] == r.root
        if r.tampered is None:
            assert r.copied is None and r.folded_root == r.root
        else:
            assert r.copied == "".join(merkle.climb(r.tampered, merkle.steps(r.proof))) and r.folded_root == r.copied[-64:]


def test_manifest_of_little(spark, docs, nothing):
    assert merkle.report(nothing).count() == 0
    one = docs.where("doc_id = 7")
    r = merkle.report(one).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha() and by_text([r]) == by_text(brute_manifest(one.collect()))
    same = docs.where("doc_id = 7").unionByName(one).unionByName(one)
    assert by_text(merkle.report(same).collect()) == by_text(brute_manifest(same.collect()))
