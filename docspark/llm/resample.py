"""Importance resampling towards a target: bucket weights from an array, then a distributed radix sort for the draw.

Words of the documents and of the target are hashed to buckets. A bucket's gain is the logarithm of its share in the target over
its share in the documents; all gains are one array that tasks look up, and a document's weight is the mean of its features'
gains. Gumbel noise seeded by doc_id turns the weighted draw without replacement into a top list.

The list comes from a least-significant-digit radix sort over the digits of a composite key (score downwards, doc_id upwards).
A pass counts a digit's values in each part, adds up the counts to the first place of every value in every part, and gives
each row that place plus its own number among the part's rows of that value: a stable counting sort, whose destinations are
dealt to parts of equal size whatever the values are. After the last pass a row's place is its rank.

Defined cases: a null text has no words, weight 0 and no rank; a null doc_id is hashed as an empty string and stands after others
of its score; rows with one score and doc_id keep the order of the table; without documents or target all counts are 0. Other
columns of the tables, whatever their names, take no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import materialize, text_slices
from docspark.llm.crcsql import CRC32_TABLE, crc32_sql

BUCKETS = 10_000
SEED = 2024
DIGIT_BITS = 12
#: Rows of a part at least; parts grow with the square root of the table, as do their number.
PART_ROWS = 1024
_SIGN = 1 << 63
#: ASCII letters in lower case, other characters but digits and non-ASCII ones to spaces.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in turn, and the bounds of each text's words. A null text has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if offsets[-1] > offsets[0] else b""
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data.translate(_PLAIN)))
    parts = pc.ascii_split_whitespace(plain)
    bounds = np.asarray(parts.offsets, dtype=np.int64) - parts.offsets[0].as_py()
    words = parts.flatten()
    real = np.asarray(pc.binary_length(words)) > 0  # white space at an end gives an empty part
    if not real.all():
        bounds, words = np.concatenate(([0], np.cumsum(real)))[bounds], words.filter(pa.array(real))
    return words, bounds


def _hashed(features: pa.Array, buckets: int) -> np.ndarray:
    coded = features.dictionary_encode()
    known = np.fromiter((zlib.crc32(w) % buckets for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.int64, len(coded.dictionary))
    return known[np.asarray(coded.indices)] if len(known) else np.zeros(0, np.int64)


def feature_buckets(texts: pa.Array, longest: int = 1, buckets: int = BUCKETS) -> list[np.ndarray]:
    """Each text's buckets: one for every run of 1 to `longest` words, joined by a space, repeats included."""
    words, bounds = word_lists(texts)
    runs = [(_hashed(words, buckets), bounds)]
    for k in range(2, longest + 1):
        joined = pc.binary_join_element_wise(*[words.slice(i, max(0, len(words) - k + 1)) for i in range(k)], " ")
        inside = np.zeros(len(joined) + 1, np.int64)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            inside[a + 1 : max(a, b - k + 1) + 1] = 1
        inside = np.cumsum(inside)
        runs.append((_hashed(joined.filter(pa.array(np.diff(inside) > 0)), buckets), inside[np.minimum(bounds, len(joined))]))
    return [np.concatenate([codes[b[i] : b[i + 1]] for codes, b in runs]) for i in range(len(texts))]


def coded(docs: DataFrame, ident: str, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, codes (the features' buckets as little-endian 32-bit integers), one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch.column(1)):
                b = batch.slice(i, j - i)
                each = feature_buckets(b.column(1), longest, buckets)
                # words of a text: runs of k words are k - 1 fewer than words, so those of one word say it
                n_words = np.diff(word_lists(b.column(1))[1]) if longest > 1 else [len(x) for x in each]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array([len(x) for x in each], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in each], pa.binary())], names=["doc_id", "n_words", "n_features", "codes"])

    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_features long, codes binary")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket. A partition gives its counts once, and the driver gets one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for c in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(c, "<u4"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = rows.select("codes").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(buckets, np.int64)
    counts[found["bucket"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return counts


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in the target over that in the source) of each bucket."""
    n, t_all, s_all = len(target), int(target.sum()), int(source.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], dtype=np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean of the gains of a document's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [int(gain[np.frombuffer(c, "<u4")].sum()) for c in b.column(3).to_pylist()]
            weights = [s // n if n else 0 for s, n in zip(sums, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weights, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(ident: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))) for a u in (0, 1) from 32 bits of the id's hash: Gumbel noise in thousandths."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def _key_bits(rows: DataFrame, order: list[Column]) -> list[tuple[Column, int]]:
    """Each long key as unsigned (first to last in its order), with the low bits in which its values differ."""
    ends = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(order) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    bits = [((ends[f"lo{i}"] + _SIGN) ^ (ends[f"hi{i}"] + _SIGN)).bit_length() for i in range(len(order))]
    return [(c.bitwiseXOR(F.lit(-_SIGN)), b) for c, b in zip(order, bits, strict=True)]


def composite_digits(keys: list[tuple[Column, int]], width: int = DIGIT_BITS) -> list[Column]:
    """Digits of `width` bits of all keys' bits in a row, least significant first; a digit may take bits of several keys."""
    pieces, at = {}, 0
    for column, bits in reversed(keys):
        low = 0
        while low < bits:
            take = min(bits - low, width - at % width)
            mask = F.shiftrightunsigned(column, low).bitwiseAND((1 << take) - 1)
            pieces.setdefault(at // width, []).append(F.shiftleft(mask, at % width))
            low, at = low + take, at + take
    return [sum(p[1:], p[0]) for _, p in sorted(pieces.items())]


def counting_pass(rows: DataFrame, digit: Column, part_rows: int) -> DataFrame:
    """One stable counting sort by a digit: rows with `part` and `pos` get the place of their destination in both."""
    rows = rows.withColumn("digit", digit.cast("int"))
    counts = rows.groupBy("part", "digit").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("digit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row a digit value, so a window over them all and a broadcast are bounded by the digit's width
    below = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    values = counts.groupBy("digit").agg(F.sum("n").alias("n")).select("digit", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("below"))
    first = counts.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(values), "digit").select("part", "digit", (F.col("below") + F.col("before")).alias("first"))
    own = F.row_number().over(Window.partitionBy("part", "digit").orderBy("pos")) - 1
    placed = rows.join(first, ["part", "digit"]).withColumn("pos", F.col("first") + own)
    return placed.withColumn("part", F.floor(F.col("pos") / part_rows)).drop("digit", "first")


def radix_ranked(rows: DataFrame, order: list[Column], width: int = DIGIT_BITS) -> DataFrame:
    """Adds `pos`, the place from 0 of each row in the ascending order of long keys (no nulls); equal rows keep the table's order."""
    rows = materialize(rows.withColumn("pos", F.monotonically_increasing_id()), "radix-0")
    n = rows.count()
    if not n:
        return rows
    digits = composite_digits(_key_bits(rows, order), width) or [F.lit(0)]
    rows, part_rows = rows.withColumn("part", F.shiftright("pos", 33)), max(PART_ROWS, math.isqrt(n))
    for i, digit in enumerate(digits, 1):
        rows = materialize(counting_pass(rows, digit, part_rows), f"radix-{i}")
    return rows.drop("part")


def resampled(docs: DataFrame, target: DataFrame, share: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every document; drawn are `share` of a hundred of those long enough."""
    own = materialize(coded(docs, "doc_id", longest, buckets), "resample-codes")
    wanted = bucket_counts(coded(target, "item_id", longest, buckets), buckets)
    scored = weighed(own, gains(wanted, bucket_counts(own, buckets))).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialize(scored, "resample-scores")
    order = [F.bitwise_not("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0)).cast("long")]
    ranked = radix_ranked(scored.where(F.col("n_words") >= least_words), order)
    most = ranked.count() * share // 100
    rank = F.when(F.col("pos") < most, F.col("pos") + 1)
    drawn = ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
    return drawn.unionByName(scored.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


_WORDS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word"
ORACLE = f"""
WITH crc AS ({CRC32_TABLE}),
d AS (SELECT doc_id, {_WORDS} FROM documents), b AS (SELECT {_WORDS} FROM benchmark),
codes AS (SELECT word, {crc32_sql("word")} % 10000 AS bucket FROM (SELECT word FROM d UNION SELECT word FROM b), crc),
s AS (SELECT bucket, count(*) AS s FROM d JOIN codes USING (word) GROUP BY ALL), t AS (SELECT bucket, count(*) AS t FROM b JOIN codes USING (word) GROUP BY ALL),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM d JOIN codes USING (word) JOIN g USING (bucket) GROUP BY ALL),
e AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN w USING (doc_id)),
r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) * 10 // 100 FROM e WHERE n_features >= 20) THEN place END AS rank FROM r"""
