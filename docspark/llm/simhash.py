"""SimHash fingerprints, their likeness, and the search of all fingerprints within a Hamming radius by permuted block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import MOST_BUCKETS, in_blocks, join_by_key, range_buckets, text_slices
from docspark.llm.shingles import mix64, word_hashes

FINGERPRINT_BITS = 64
#: Hamming radius; a fingerprint is cut in BLOCKS parts, and two within RADIUS agree on at least BLOCKS - RADIUS of them.
RADIUS, BLOCKS = 3, 6
#: Documents of one range bucket, in which neighbours in doc_id order are found.
BUCKET_ROWS = 4096
BLOCK_ROWS = 2048

_EDGES = [round(i * FINGERPRINT_BITS / BLOCKS) for i in range(BLOCKS + 1)]
_MASKS = [sum(1 << b for b in range(_EDGES[i], _EDGES[i + 1])) for i in range(BLOCKS)]
_TABLES = list(combinations(range(BLOCKS), BLOCKS - RADIUS))
_SIGN = (1 << 63) - 1


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Terms are pairs of neighbouring words (a lone word is one term), weighted by 1 + ln of their count in the text,
    in steps of 1/64; each term's hash votes with its weight for or against every bit. A text without words has fingerprint 0;
    ties count against. Votes are whole numbers, so they are the same in any order."""
    words, offsets = word_hashes(texts)
    pairs = mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else np.zeros(0, np.uint64)
    out = np.zeros(len(texts), np.uint64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b == a:
            continue
        terms, counts = np.unique(pairs[a : b - 1] if b - a > 1 else mix64(words[a:b]), return_counts=True)
        weights = np.rint(64 * (1 + np.log(counts))).astype(np.float32)
        votes = np.zeros(FINGERPRINT_BITS, np.int64)
        for k in range(0, len(terms), 4096):  # a long text's votes add up piece by piece
            bits = np.unpackbits(terms[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += (weights[k : k + 4096] @ bits.astype(np.float32)).astype(np.int64)  # whole numbers under 2**24 are exact
        up = votes * 2 > weights.sum(dtype=np.float64)
        out[i] = np.packbits(up, bitorder="little").view("<u8")[0]
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(x ^ y) / FINGERPRINT_BITS


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) of every whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in text_slices(b.column(1)):
                fp = fingerprints(b.column(1).slice(i, j - i)).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def within_radius(fps: DataFrame) -> DataFrame:
    """fp, copies (rows with it), near (rows with another fingerprint within RADIUS bits).

    A fingerprint stands in one table for every choice of blocks that two within the radius may agree on; a pair counts in
    the first table where it meets. Only counts leave a bucket, never pairs; large buckets are compared in blocks.
    """
    distinct = fps.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"))
    masks = [sum(_MASKS[i] for i in t) for t in _TABLES]
    signed = [m if m <= _SIGN else m - (1 << 64) for m in masks]
    entries = distinct.select("fp", "copies", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("table", "key"))
    first = np.full(1 << BLOCKS, len(_TABLES), np.int64)
    for agree in range(1 << BLOCKS):
        for k in reversed(range(len(_TABLES))):
            if all(agree >> i & 1 for i in _TABLES[k]):
                first[agree] = k

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame["table"].iat[0]
        left, right = frame[frame["sub"] == frame["bi"]], frame[frame["sub"] == frame["bj"]]
        both = frame["bi"].iat[0] != frame["bj"].iat[0]
        x, y = (p["fp"].to_numpy().view(np.uint64) for p in (left, right))
        cx, cy = left["copies"].to_numpy(), right["copies"].to_numpy()
        near_x, near_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        for i in range(0, len(x), 64):
            d = x[i : i + 64, None] ^ y[None, :]
            hit = (np.bitwise_count(d) <= RADIUS) & (d != 0)
            at = np.nonzero(hit)
            agree = sum(((d[at] & np.uint64(m)) == 0).astype(np.int64) << k for k, m in enumerate(_MASKS))
            own = first[agree] == table
            a, b = at[0][own] + i, at[1][own]
            np.add.at(near_x, a, cy[b])
            if both:
                np.add.at(near_y, b, cx[a])
        out = pd.DataFrame({"fp": left["fp"].to_numpy(), "near": near_x})
        if both:
            out = pd.concat([out, pd.DataFrame({"fp": right["fp"].to_numpy(), "near": near_y})])
        return out[out["near"] > 0]

    blocks = in_blocks(entries, ["table", "key"], F.xxhash64("fp"), BLOCK_ROWS)
    counts = blocks.groupBy("table", "key", "bi", "bj").applyInPandas(run, "fp long, near long").groupBy("fp").agg(F.sum("near").alias("near"))
    return distinct.join(counts, "fp", "left").select("fp", "copies", F.coalesce("near", F.lit(0)).cast("long").alias("near"))


def hash_buckets(rows: DataFrame) -> DataFrame:
    """Numbers `bucket` anew, in the same order: rows of a hot doc_id, or of none, go to ranges of their hash `h`, from the
    highest number down. A hot id has over BUCKET_ROWS rows and over 1 / MOST_BUCKETS of all, so they are at most MOST_BUCKETS.
    """
    least = max(BUCKET_ROWS, -(-rows.count() // MOST_BUCKETS))
    hot = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > least) | F.col("doc_id").isNull())
    hot = hot.select(F.col("doc_id").alias("hot_id"), F.ceil(F.col("n") / least).alias("m"))
    known = hot.collect()
    if not known:
        return rows.withColumn("bucket", F.col("bucket").cast("long"))
    hot = F.broadcast(rows.sparkSession.createDataFrame(known, hot.schema))
    ids = sorted(r.hot_id for r in known if r.hot_id is not None)
    # inside a bucket nulls take place 0, the k-th hot id 2 k + 2, and the ids between the hot ones the odd places
    below = F.array_size(F.filter(F.array(*map(F.lit, ids)).cast("array<long>"), lambda v: v < F.col("doc_id")))
    place = F.when(F.col("doc_id").isNull(), 0).otherwise(2 * below + F.when(F.col("m").isNull(), 1).otherwise(2)).cast("long")
    share = (F.col("h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    part = F.coalesce(F.col("m") - 1 - F.least(F.floor(share * F.col("m")), F.col("m") - 1), F.lit(0)).cast("long")
    number = (F.col("bucket").cast("long") * F.lit(1 << 15) + place) * F.lit(1 << 14) + part
    return rows.join(hot, F.col("doc_id").eqNullSafe(F.col("hot_id")), "left").withColumn("bucket", number).drop("hot_id", "m")


def in_turn(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_id, next_text: the next document in descending doc_id (the last: the first; null ids come last), equal ids by a hash of the text.

    Range buckets of about BUCKET_ROWS documents keep neighbours together; only each bucket's first document crosses over. A
    doc_id with more rows than a bucket should hold, or none, has buckets of its own, ranges of the hash; equal rows share one.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = hash_buckets(range_buckets(rows, "doc_id", BUCKET_ROWS).withColumn("h", F.xxhash64("text")))
    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "h", "text")
    inside = rows.select("doc_id", "text", "bucket", F.lead("doc_id").over(order).alias("next_id"), F.lead("text").over(order).alias("next_text"), F.lead(F.lit(True)).over(order).alias("has_next"))
    # of each bucket's first document its id and text hash alone are put in order; its text comes by a join
    first = F.struct(F.col("doc_id").isNull().alias("n"), (-F.col("doc_id")).alias("o"), "h")
    tops = rows.groupBy("bucket").agg(F.min(first).alias("top")).select(F.col("bucket").alias("b2"), (-F.col("top.o")).alias("d2"), F.col("top.h").alias("h2"))
    before = F.lag("b2").over(Window.orderBy("b2"))
    ends = tops.select(F.col("b2").alias("b1"), F.coalesce(before, F.max("b2").over(Window.partitionBy())).alias("b2"))
    same = (F.col("bucket") == F.col("b2")) & F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2"))
    texts = rows.join(F.broadcast(tops), same).groupBy("b2").agg(F.first(F.struct("doc_id", "text")).alias("after"))  # equal ones have one text
    follow = ends.join(texts, "b2").select("b1", "after")
    joined = inside.join(follow.hint("merge"), (F.col("bucket") == F.col("b1")) & F.col("has_next").isNull(), "left")
    return joined.select("doc_id", "text", F.coalesce("next_id", "after.doc_id").alias("next_id"), F.coalesce("next_text", "after.text").alias("next_text"))


REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, fp long"


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """For every document: length, fingerprint, the edited text's digest and fingerprint, likeness to it and to the next
    document, and how many documents lie within RADIUS bits of it (its copies included, itself not).

    The edited text has its last n_chars // 3 code points replaced by the first as many (or all) of the next document. Null
    texts count as empty, with fingerprint 0; repeated rows are documents of their own; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column(1)):
                b = batch.slice(i, j - i)
                texts, nexts = b.column(1).to_pylist(), b.column(2).to_pylist()
                edited = [t[: len(t) - len(t) // 3] + x[: len(t) // 3] for t, x in zip(texts, nexts, strict=True)]
                fp, fe = fingerprints(b.column(1)), fingerprints(pa.array(edited, pa.string()))
                # the next row is mostly the next document
                follows = [x is y or x == y for x, y in zip(nexts, [*texts[1:], None], strict=True)]
                fn = np.concatenate((fp[1:], np.zeros(1, np.uint64)))
                lone = [k for k, f in enumerate(follows) if not f]
                fn[lone] = fingerprints(pa.array([nexts[k] for k in lone], pa.string()))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column(0), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                    "fingerprint": [f"{x:016x}" for x in fp.tolist()], "edited_fingerprint": [f"{x:016x}" for x in fe.tolist()],
                    "near_edited": likeness(fp, fe), "near_next": likeness(fp, fn), "fp": fp.view(np.int64),
                })

    turned = in_turn(docs).select("doc_id", "text", "next_text")
    return turned.mapInArrow(run, REPORT)


def report_with_links(docs: DataFrame, save) -> DataFrame:
    """fingerprint_report() with `n_within`; save(frame) keeps the report, which is needed twice."""
    report = save(fingerprint_report(docs))
    links = save(within_radius(report.select("fp"))).select("fp", "copies", (F.col("copies") - 1 + F.col("near")).alias("n_within"))
    return join_by_key(report, links, ["fp"], "copies").drop("fp", "copies")
