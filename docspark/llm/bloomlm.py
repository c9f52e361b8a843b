"""Language-model scoring with a log-frequency Bloom filter (Talbot and Osborne, 2007).

An n-gram with count c has level 1 + floor(log_BASE c), and all pairs (n-gram, 1) to (n-gram, level) are members of a Bloom
filter. Probing levels upward until one is missing gives the count's level back; errors only ever raise it. The filter holds
quantised counts of one and two words; a two-word probability is interpolated with the one-word one by the share of two-word
occurrences seen once (the Good-Turing mass of unseen ones). Filter segments are built on the cluster, one a hash range.

The filter has BITS_EACH bits a member at every size. While it is small, tasks write the segments to a few files in the shared
folder, of which the driver gets the index alone, and the workers of a node map one copy of each. Exact one-word counts, which
the base score needs, are looked up in such files when they are few, and by an equi-join on the word beyond. A larger filter is never in one place: the n-grams of a chunk of texts go to their segments, which answer with levels
and exact counts, and the answers go back to the chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import SLICE_BYTES, filesystem, materialize, shared_array, shared_path, text_slices
from docspark.llm.shingles import mix64, word_hashes

BASE = 1.5
MOST_LEVEL = 80
PROBES = 5
#: Bits for each member, and the bits up to which all segments are mapped (256 MB); beyond, n-grams go to their segments.
BITS_EACH, MAPPED_BITS = 10, 1 << 31
#: Bytes that one mapped file holds, about.
FILE_BYTES = 16 << 20
#: Distinct n-grams of one segment; a segment is built in one task.
SEGMENT_GRAMS = 1 << 19
#: Exact counts are looked up in a file up to so many distinct words (16 bytes each).
BROADCAST_WORDS = 20_000_000
#: Bytes of text scored at once.
SCORE_BYTES = 1 << 20
#: Words and n-grams a counting task gathers before it hands on a partial count.
GATHER = 1 << 21

END = np.uint64(0x51ED270B8D2C4F17)
START = np.uint64(0xA24BAED4963EE407)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes (words, then one end) of all texts, and the number of each."""
    words, bounds = word_hashes(texts)
    return np.insert(words, bounds[1:], END), np.diff(bounds) + 1


def bigrams(tok: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token with the one before it in its text (the first: with a start), and the hash of that one."""
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[np.cumsum(n) - n] = START
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + tok), before


def levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(MOST_LEVEL, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64))


def level_count(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range, 1 for the first, 0 for none."""
    mid = (BASE ** (level - 1.0) + BASE ** np.maximum(level, 1)) / 2
    return np.where(level <= 0, 0.0, np.where(level <= 2, np.maximum(level, 1), mid))


def _gathered(docs: DataFrame, segments: int) -> DataFrame:
    """kind (1: word, 2: pair), segment, grams (sorted 64-bit hashes), counts: partial counts of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                if not held[kind]:
                    continue
                grams, counts = np.unique(np.concatenate(held[kind]), return_counts=True)
                order, to, cuts = _dealt(grams, segments)
                grams, counts = grams[order], counts[order].astype("<u8")
                rows = [(s, grams[a:b].tobytes(), counts[a:b].tobytes()) for s, a, b in zip(to.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                held[kind] = []
                if not rows:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([kind + 1] * len(rows), pa.int32()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True))], names=["kind", "segment", "grams", "counts"])

        for b in batches:
            for i, j in text_slices(b.column(0)):
                tok, n = tokens(b.column(0).slice(i, j - i))
                held[0].append(tok)
                held[1].append(bigrams(tok, n)[0])
                size += len(tok)
                if size >= GATHER:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "kind int, segment int, grams binary, counts binary")


def _merge(grams: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    g, c = np.frombuffer(b"".join(grams), "<u8"), np.frombuffer(b"".join(counts), "<u8").astype(np.int64)
    order = np.argsort(g, kind="stable")
    g = g[order]
    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    return g[starts], np.add.reduceat(c[order], starts) if len(starts) else c


SEGMENT = "kind int, segment int, grams binary, counts binary, distinct long, tokens long, once long, members long"


def count(docs: DataFrame, segments: int) -> DataFrame:
    """Exact counts of one and two words over all training texts, one row a kind and segment."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        g, c = _merge(list(frame["grams"]), list(frame["counts"]))
        return pd.DataFrame({"kind": frame["kind"].iloc[:1], "segment": frame["segment"].iloc[:1], "grams": [g.tobytes()], "counts": [c.astype("<u8").tobytes()], "distinct": [len(g)], "tokens": [int(c.sum())], "once": [int((c == 1).sum())], "members": [int(levels(c).sum())]})

    return _gathered(docs, segments).groupBy("kind", "segment").applyInPandas(run, SEGMENT)


def _probes(keys: np.ndarray, level: np.ndarray | int, size: np.ndarray) -> np.ndarray:
    """Bit positions inside a segment of `size` bits, one column a probe."""
    h = mix64(keys + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) >> np.uint64(7)) % size.astype(np.uint64)[:, None]


def segment_bits(grams: np.ndarray, counts: np.ndarray, size: int) -> bytes:
    out = np.zeros(size, dtype=bool)
    level = levels(counts)
    for j in range(1, int(level.max(initial=0)) + 1):
        keys = grams[level >= j]
        out[_probes(keys, j, np.full(len(keys), size)).ravel().astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def _segment_size(members: int) -> int:
    return max(64, members * BITS_EACH)


def _levels_of(keys: np.ndarray, bits: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Levels of n-grams whose segment has `size` bits from byte `first` on."""
    out = np.zeros(len(keys), np.int64)
    alive = np.flatnonzero(size > 0)
    for j in range(1, MOST_LEVEL + 1):
        if not len(alive):
            break
        at = _probes(keys[alive], j, size[alive]).astype(np.int64)
        hit = np.ones(len(alive), bool)
        for k in range(PROBES):
            hit &= (bits[first[alive] + (at[:, k] >> 3)] >> (at[:, k] & 7).astype(np.uint8) & 1).astype(bool)
        alive = alive[hit]
        out[alive] = j
    return out


def write_files(rows: DataFrame, parts: int) -> list:
    """Write the data of rows (kind, segment, data) to `parts` files, one task each; kind, segment, file, first, size (bytes) of each."""
    folder = shared_path(rows.sparkSession, "lm-files")

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, at, firsts = uuid.uuid4().hex, 0, []
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            for data in frame["data"]:
                firsts.append(at)
                out.write(data)
                at += len(data)
            out.write(b"\0" * 8)  # an empty file can't be mapped
        return pd.DataFrame({"kind": frame["kind"], "segment": frame["segment"], "file": f"{folder}/{name}", "first": firsts, "size": frame["data"].map(len)})

    return rows.groupBy(F.pmod("segment", F.lit(parts)).alias("part")).applyInPandas(write, "kind int, segment int, file string, first long, size long").collect()


@dataclass
class LogFrequencyFilter:
    segments: int
    sizes: np.ndarray  # bits, (kind, segment)
    firsts: np.ndarray  # first byte in its file
    bits: list | None  # arrays, or the files that hold them, segment s in number s % len; None: built and probed segment by segment
    train_tokens: int
    distinct: int
    unseen: float  # mass of unseen two-word continuations
    texts: int  # training texts: the count of a text's start

    def level(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """Levels of n-grams by probing 1, 2, ... until one is missing."""
        if self.bits is None:
            raise ValueError("this filter is not mapped: its segments are probed where they are built")
        own = (keys % np.uint64(self.segments)).astype(np.int64)
        out = np.zeros(len(keys), np.int64)
        for p, bits in enumerate(self.bits):
            at = np.flatnonzero(own % len(self.bits) == p) if len(self.bits) > 1 else slice(None)
            mapped = shared_array(bits, "u1") if isinstance(bits, str) else bits
            out[at] = _levels_of(keys[at], mapped, self.sizes[kind - 1][own[at]], self.firsts[kind - 1][own[at]])
        return out

    def log_probabilities(self, tok: np.ndarray, n: np.ndarray, level: Callable[[np.ndarray, int], np.ndarray] | None = None) -> np.ndarray:
        """log10 of every token's interpolated probability given the one before it; `level` stands in for the mapped filter."""
        level = level or self.level
        two, before = bigrams(tok, n)
        words, at = np.unique(np.concatenate((tok, before)), return_inverse=True)
        one = level_count(level(words, 1))
        one[words == START] = 0
        unigram = (one + 0.5) / (self.train_tokens + 0.5 * (self.distinct + 1))
        pairs, pair_at = np.unique(two, return_inverse=True)
        both = level_count(level(pairs, 2))[pair_at]
        context = one[at[len(tok) :]]
        context[before == START] = self.texts
        seen = np.minimum(1.0, both / np.maximum(context, np.maximum(both, 1)))
        known = context > 0
        weight = np.where(known, 1 - self.unseen, 0.0)
        return np.log10(weight * seen + (1 - weight) * unigram[at[: len(tok)]])


def fit(counts: DataFrame, segments: int, texts: int) -> LogFrequencyFilter:
    """Build the filter's segments on the cluster and gather them, unless they have more than MAPPED_BITS bits in all."""
    totals = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("distinct").alias("distinct"), F.sum("tokens").alias("tokens"), F.sum("once").alias("once"), F.sum("members").alias("members")).collect()}
    members = sum(r["members"] for r in totals.values())
    one, two = totals.get(1), totals.get(2)
    unseen = min(0.99, max(0.01, two["once"] / two["tokens"])) if two and two["tokens"] else 0.99
    sizes, firsts = np.zeros((2, segments), np.int64), np.zeros((2, segments), np.int64)
    lm = LogFrequencyFilter(segments, sizes, firsts, None, int(one["tokens"]) if one else 0, int(one["distinct"]) if one else 0, float(unseen), max(1, texts))
    if members * BITS_EACH > MAPPED_BITS:
        return lm

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                size = _segment_size(r["members"])
                bits = segment_bits(np.frombuffer(r["grams"], "<u8"), np.frombuffer(r["counts"], "<u8"), size)
                yield pa.RecordBatch.from_pydict({"kind": pa.array([r["kind"]], pa.int32()), "segment": pa.array([r["segment"]], pa.int32()), "data": pa.array([bits], pa.binary())})

    built = counts.select("kind", "segment", "grams", "counts", "members").mapInArrow(build, "kind int, segment int, data binary")
    parts = max(1, -(-members * BITS_EACH // (8 * FILE_BYTES)))
    lm.bits = [""] * parts
    for r in write_files(built, parts):
        firsts[r["kind"] - 1, r["segment"]] = r["first"]
        lm.bits[r["segment"] % parts] = r["file"]
    for r in counts.select("kind", "segment", "members").collect():
        sizes[r["kind"] - 1, r["segment"]] = _segment_size(r["members"])
    lm.bits = [b or np.zeros(8, np.uint8) for b in lm.bits]
    return lm


def _runs(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The distinct keys, and the values at each."""
    cuts = np.flatnonzero(np.diff(sorted_keys)) + 1
    return sorted_keys[np.concatenate(([0], cuts))].tolist() if len(sorted_keys) else [], np.split(values, cuts) if len(values) else []


def _dealt(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of sorted keys by segment, the segments that have any, and their bounds in it."""
    own = (keys % np.uint64(segments)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    to, first = np.unique(own[order], return_index=True)
    return order, to, np.append(first, len(keys))


def _asked(tok: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words (with the start) and pairs of some texts."""
    two, before = bigrams(tok, n)
    return np.unique(np.concatenate((tok, before))), np.unique(two)


CHUNK = "chunk long, doc_id long, held_out boolean, text string"


def _scores_by_segment(rows: DataFrame, counts: DataFrame, lm: LogFrequencyFilter) -> DataFrame:
    """Scores by a filter of any size: its segments are built and probed each in its own group, with the n-grams asked of it.

    A segment is asked for an n-gram once a chunk of texts, so its group grows with the texts a segment stands for and not
    with the corpus. Chunks are groups of plain rows: as one row with an array each, readers and writers would hold thousands of them at once.
    """
    segments, room = lm.segments, lm.train_tokens + 0.5 * (lm.distinct + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = 0, 0
        for b in batches:
            for i, j in text_slices(b.column(2)):
                part = b.slice(i, j - i)
                more = pc.sum(pc.binary_length(part.column(2))).as_py() or 0
                if size and size + more > SLICE_BYTES:
                    number, size = number + 1, 0
                size += more
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, (b.column(3)[0].as_py() << 40) + number)), part.column(0), part.column(1), part.column(2)], names=["chunk", "doc_id", "held_out", "text"])

    def ask(chunk: pa.Table) -> pa.Table:
        found = []
        for kind, keys in enumerate(_asked(*tokens(chunk.column("text").combine_chunks())), 1):
            order, to, cuts = _dealt(keys, segments)
            asked = [keys[order[a:b]].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            found.append(pa.table([pa.array(np.full(len(to), chunk.column("chunk")[0].as_py())), pa.array(np.full(len(to), kind, np.int32)), pa.array(to.astype(np.int32)), pa.array(asked, pa.binary())], names=["chunk", "kind", "segment", "keys"]))
        return pa.concat_tables(found)

    def answer(asked: pd.DataFrame, learnt: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(asked["keys"]), "<u8")
        level, number = np.zeros(len(keys), np.uint8), np.zeros(len(keys), "<u8")
        if len(learnt) and len(keys):
            grams, c = np.frombuffer(learnt["grams"].iat[0], "<u8"), np.frombuffer(learnt["counts"].iat[0], "<u8")
            size = _segment_size(int(learnt["members"].iat[0]))
            bits = np.frombuffer(segment_bits(grams, c, size), np.uint8)
            level = _levels_of(keys, bits, np.full(len(keys), size), np.zeros(len(keys), np.int64)).astype(np.uint8)
            if learnt["kind"].iat[0] == 1:
                where = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
                number = np.where(grams[where] == keys, c[where], 0).astype("<u8")
        lens = asked["keys"].map(len).to_numpy(np.int64) >> 3
        ends = np.cumsum(lens)
        spans = list(zip((ends - lens).tolist(), ends.tolist(), strict=True))
        exact = [number[a:b].tobytes() if k == 1 else b"" for k, (a, b) in zip(asked["kind"], spans, strict=True)]
        return pd.DataFrame({"chunk": asked["chunk"], "kind": asked["kind"], "segment": asked["segment"], "levels": [level[a:b].tobytes() for a, b in spans], "counts": exact})

    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        ids, held, texts = (chunk.column(name).combine_chunks() for name in ("doc_id", "held_out", "text"))
        tok, n = tokens(texts)
        keys, found, number = _asked(tok, n), [], np.zeros(0)
        answers = answers.sort_by("segment")
        for kind in (1, 2):
            own = answers.filter(pc.equal(answers.column("kind"), kind))
            order = _dealt(keys[kind - 1], segments)[0]
            out = np.zeros(len(order), np.int64)
            out[order] = np.frombuffer(b"".join(own.column("levels").to_pylist()), np.uint8)
            found.append(out)
            if kind == 1:
                number = np.zeros(len(order))
                number[order] = np.frombuffer(b"".join(own.column("counts").to_pylist()), "<u8")
        c, starts = number[np.searchsorted(keys[0], tok)], np.cumsum(n) - n
        model = lm.log_probabilities(tok, n, lambda _, kind: found[kind - 1])
        return pa.table([ids, held, pa.array(n), pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)), pa.array(np.full(len(n), lm.train_tokens)), pa.array(np.add.reduceat(np.log10((c + 0.5) / room), starts)), pa.array(np.add.reduceat(model, starts))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    chunks = materialize(rows.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(deal, CHUNK), "lm-chunks")
    # the same columns as for the scores, so that the texts are dealt to their chunks once for both
    asked = chunks.groupBy("chunk").applyInArrow(ask, "chunk long, kind int, segment int, keys binary")
    learnt = counts.select("kind", "segment", "grams", "counts", "members")
    answers = asked.groupBy("kind", "segment").cogroup(learnt.groupBy("kind", "segment")).applyInPandas(answer, "chunk long, kind int, segment int, levels binary, counts binary")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, SCORED)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Base and model scores of every whole text, learnt from those not held out.

    A null text is empty and has its end token alone; a null doc_id is never held out; repeated rows are counted and scored
    each; an empty table gives an empty result; columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    train = docs.where(~held_out())
    size = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    segments = max(1, -(-int(size["chars"]) // (8 * SEGMENT_GRAMS)))  # about two n-grams every 8 characters at the most
    counts = materialize(count(train, segments), "lm-counts")
    model = spark.sparkContext.broadcast(fit(counts, segments, int(size["n"])))
    lm = model.value
    words = counts.where("kind = 1").select("segment", "grams", "counts")
    n_train, room = lm.train_tokens, lm.train_tokens + 0.5 * (lm.distinct + 1)
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    if lm.bits is None:
        return _scores_by_segment(rows, counts, lm)
    if lm.distinct <= broadcast_words:
        # a segment's words and, behind them, their counts
        index = {r["segment"]: (r["file"], r["first"] // 8, r["size"] // 16) for r in write_files(words.select(F.lit(1).alias("kind"), "segment", F.concat("grams", "counts").alias("data")), max(1, -(-16 * lm.distinct // FILE_BYTES)))}
        placed = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, j in text_slices(b.column(2), SCORE_BYTES):
                    part = b.slice(i, j - i)
                    tok, n = tokens(part.column(2))
                    distinct, at = np.unique(tok, return_inverse=True)
                    own = (distinct % np.uint64(segments)).astype(np.int64)
                    order = np.argsort(own, kind="stable")
                    c = np.zeros(len(distinct))
                    for seg, some in zip(*_runs(own[order], order), strict=True):
                        file, lo, k = placed.value.get(seg, ("", 0, 0))
                        if k:
                            data = shared_array(file, "<u8")
                            grams, number = data[lo : lo + k], data[lo + k : lo + 2 * k]
                            where = np.minimum(np.searchsorted(grams, distinct[some]), k - 1)
                            c[some] = np.where(grams[where] == distinct[some], number[where], 0)
                    base, starts = np.log10((c + 0.5) / room), np.cumsum(n) - n
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(np.add.reduceat((c > 0)[at].astype(np.int64), starts)), pa.array(np.full(len(n), n_train)), pa.array(np.add.reduceat(base[at], starts)), pa.array(np.add.reduceat(model.value.log_probabilities(tok, n), starts))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        return rows.mapInArrow(run, SCORED)

    keyed = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "lm-rows")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in text_slices(b.column(1)):
                part = b.slice(i, j - i)
                tok, n = tokens(part.column(1))
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((tok, owner))
                tok, owner = tok[order], owner[order]
                new = np.concatenate(([True], (tok[1:] != tok[:-1]) | (owner[1:] != owner[:-1])))
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[at])), pa.array(tok[at].view(np.int64)), pa.array(np.diff(np.append(at, len(tok))))], names=["row", "word", "n"])

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["grams"], "<i8")), pa.array(np.frombuffer(r["counts"], "<i8"))], names=["word", "c"])

    def model_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in text_slices(b.column(2), SCORE_BYTES):
                part = b.slice(i, j - i)
                tok, n = tokens(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(n), pa.array(np.add.reduceat(model.value.log_probabilities(tok, n), np.cumsum(n) - n))], names=["doc_id", "held_out", "row", "n_tokens", "score"])

    exact = words.select("grams", "counts").mapInArrow(flat, "word long, c long")
    found = keyed.select("row", "text").mapInArrow(spread, "row long, word long, n long").join(exact, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    base = found.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"), F.sum(F.col("n") * F.log10((F.col("c") + F.lit(0.5)) / F.lit(room))).alias("base_score"))
    modelled = keyed.mapInArrow(model_scores, "doc_id long, held_out boolean, row long, n_tokens long, score double")
    return modelled.join(base, "row").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
