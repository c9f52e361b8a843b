"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents are put in a pseudo-random order (md5 of seed, doc_id and text) and cut into blocks of words. A tree over
the output shards splits the exact block quotas of all sources at once: a node draws its left child's blocks from the
multivariate hypergeometric law, so every shard gets whole blocks, quotas add up exactly, and shards stay mixed. Each
leaf walks its own path with random numbers seeded by the node, so leaves need no communication and may be redone anywhere.
The pieces of a leaf's blocks are written as its shard, shuffled there; what the mix takes is read back from the shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import materialize

BLOCK_WORDS = 4096
SHARD_WORDS = 4_000_000
#: Rows that a sub-bucket of a source may have, so that no window holds a whole source; buckets are leading hex digits of the md5.
BUCKET_ROWS = 50_000
WEIGHTS = (3, 1, 2)
#: A draw is made among less than a thousand million blocks; with more words than MOST_BLOCKS blocks hold, blocks grow.
MOST_BLOCKS = 1 << 29
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def word_sizes(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """row (tells repeated rows apart), doc_id, source, size (words of the whole text; null text: 0), digest (md5 of the text; null: empty)."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return docs.select((F.monotonically_increasing_id() if row is None else row).alias("row"), F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), digest.alias("digest"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: the weighted shares of `share` times all words, none above `most` times its source.

    Sources in code-point order, null last, take the weights in turn. The excess of a source at its cap goes to the others by
    weight until none is above its own: sources fill up in the order of cap over weight, so with that order one pass of
    running sums finds the sources at their caps. One row a source; an empty input gives no rows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    fill = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights)).cast("int") + 1)
    return (
        per.withColumn("n", F.row_number().over(by_name) - 1)
        .withColumn("weight", w.cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("left_total", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", F.col("ratio") <= F.col("left_total") / F.col("left_weight"))
        .withColumn("level", F.min(F.when(~F.col("full"), F.col("left_total") / F.col("left_weight"))).over(everything))
        .withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("level")))
        .select("source", "source_size", "target")
    )


def permuted(sizes: DataFrame, seed: int) -> DataFrame:
    """Adds `first`: words of the source before the document in its random order. Two-level running sums.

    The order is by id and text, so texts under one doc_id, or under none, are spread like any others; rows equal in both
    have one size and stand next to each other.
    """
    digits = max(3, math.ceil(math.log(max(1, sizes.count() / BUCKET_ROWS), 16)))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.lower(F.hex("digest"))).cast("binary"))
    rows = sizes.withColumn("key", key).withColumn("bucket", F.substring("key", 1, digits))
    order = Window.partitionBy("source", "bucket")
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = order.orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(buckets, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
        .withColumn("first", F.col("base") + F.col("inner"))
        .select("row", "doc_id", "source", "size", "first")
    )


def _path(shard: int, shards: int, quotas: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each source in one leaf of the splitting tree."""
    lo, hi, have, first = 0, shards, quotas.copy(), np.zeros_like(quotas)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        n = int(have.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = rng.multivariate_hypergeometric(have, n, method="marginals") if have.sum() else have.copy()
        if shard < mid:
            hi, have = mid, left
        else:
            lo, first, have = mid, first + left, have - left
    return first, have


def splitting_tree(targets: DataFrame, block_words: int, shard_words: int, seed: int) -> DataFrame:
    """source, block, shard: every block of every source's quota in exactly one output shard.

    The quotas, one number a source, are the only thing every leaf needs; they travel as one array row.
    """
    quota = F.ceil(F.round("target") / F.lit(block_words)).cast("long")
    root = (
        targets.select("source", quota.alias("quota"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("no_name"), "source", "quota"))).alias("quotas"))
        .withColumn("shards", F.greatest(F.lit(1), F.ceil(F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q["quota"]) * F.lit(block_words) / F.lit(shard_words))).cast("long"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    )

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for quotas, shards, shard in zip(frame["quotas"], frame["shards"], frame["shard"], strict=True):
                if len(quotas) == 0:
                    continue
                first, n = _path(int(shard), int(shards), np.array([q["quota"] for q in quotas], dtype=np.int64), seed)
                yield pd.DataFrame({"source": [q["source"] for q in quotas], "first_block": first, "blocks": n, "shard": int(shard)})

    parts = root.select("shards").limit(1).collect()  # a number, as adaptive execution would merge such small rows into one task
    leaves = root.repartition(min(1024, int(parts[0]["shards"]) if parts else 1), "shard").mapInPandas(walk, "source string, first_block long, blocks long, shard long").where("blocks > 0")
    return leaves.select("source", "shard", F.explode(F.sequence(F.col("first_block"), F.col("first_block") + F.col("blocks") - 1)).alias("block"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 17, row: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix's shards, as written, and the documents' table.

    First: shard, place, row, doc_id, source, pass (1 or 2), start, words (the part of the document taken), block. Shards
    stand together in the files, each in the order of `place`, which is random. Second: row, doc_id, source, size, first,
    source_size, target. A source's word stream of round(target) words runs over its documents in random order, and over
    them again for the part of the target beyond the source's size. `row` numbers the rows of docs where they have a number.
    Null or empty texts have size 0 and are never taken; a null source is a source; repeated rows count each; an empty table
    gives empty results; columns other than doc_id, source and text are not read.
    """
    sizes = materialize(word_sizes(docs, row), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, share, most), "mix-targets")
    placed = (
        permuted(sizes, seed)
        .join(targets.select(F.col("source").alias("s3"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s3")))
        .drop("s3")
    )
    placed = materialize(placed, "mix-placed")
    total = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count(F.lit(1))).first()
    block_words = max(block_words, math.ceil(total[0] / max(1, MOST_BLOCKS - total[1])))
    goal = F.round("target").cast("long")
    passes = placed.where("size > 0").withColumn("pass", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("at", F.col("first") + (F.col("pass") - 1) * F.col("source_size"))
    pieces = (
        passes.withColumn("stop", F.least(F.col("at") + F.col("size"), goal))
        .where("stop > at")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("stop") - 1) / block_words))))
        .withColumn("from", F.greatest(F.col("at"), F.col("block") * block_words))
        .withColumn("to", F.least(F.col("stop"), (F.col("block") + 1) * block_words))
        .select("row", "doc_id", "source", "pass", (F.col("from") - F.col("at")).alias("start"), (F.col("to") - F.col("from")).alias("words"), "block")
    )
    tree = splitting_tree(targets, block_words, shard_words, seed).select(F.col("source").alias("s4"), F.col("block").alias("b4"), "shard")
    # a row a block on either side, so neither is broadcast; no key has more than a block's documents
    mixed = pieces.hint("merge").join(tree, F.col("source").eqNullSafe(F.col("s4")) & (F.col("block") == F.col("b4"))).drop("s4", "b4")
    place = F.xxhash64(F.lit(seed), "shard", "source", "block", "row", "pass")
    shards = mixed.withColumn("place", place).repartition("shard").sortWithinPartitions("shard", "place", "row", "pass")
    return materialize(shards.select("shard", "place", "row", "doc_id", "source", "pass", "start", "words", "block"), "mix-shards"), placed


def taken(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the document in the written shards, repeats counted), first_shard (the lowest with any)."""
    shards, placed = mix(docs, **how)
    got = shards.groupBy("row").agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"))
    joined = placed.join(got, "row", "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word and the white space after it."""
    lead = F.when(text.rlike(f"^{SPACE}"), 1).otherwise(0)
    rest = F.element_at(F.split(text, SPACE, (n + 1 + lead).cast("int")), -1)
    return F.left(text, F.length(text) - F.length(rest))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents, with the columns of `docs`.

    One row for each pass that takes any of a document's words, in the shard and place of its first piece. Texts are dealt to
    partitions by document, in one shuffle; inside a partition shards follow each other, each in its random order. The one document
    of a source at which its target ends is cut there, after the words that the mix takes (`n_chars`, where there is such a
    column, is that of the cut text); all others are whole.
    """
    keyed = materialize(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*docs.columns).alias("_doc")), "mix-documents")
    shards, placed = mix(keyed.select("_row", "_doc.doc_id", "_doc.source", "_doc.text"), row=F.col("_row"), **how)
    rows = shards.groupBy("row", "pass").agg(F.sum("words").alias("words"), F.min(F.struct("block", "start", "shard", "place")).alias("at"))
    rows = rows.join(placed.select("row", "size"), "row").select(F.col("row").alias("_row"), "words", "size", F.col("at.shard").alias("shard"), F.col("at.place").alias("place"))
    joined = keyed.join(rows, "_row")
    text, cut = F.col("_doc.text").cast("string"), F.col("words") < F.col("size")
    short = first_words(text, F.col("words"))
    new = {"text": F.when(cut, short).otherwise(text)} | ({"n_chars": F.when(cut, F.length(short)).otherwise(F.col("_doc.n_chars"))} if "n_chars" in docs.columns else {})
    out = joined.select("shard", "place", *[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"_doc.{c}")).alias(f"_{i}") for i, c in enumerate(docs.columns)])
    return out.sortWithinPartitions("shard", "place").select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


ORACLE = """
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS n FROM per),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM named),
r AS (SELECT *, cap / weight AS ratio, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM w),
f AS (SELECT *, total - coalesce(sum(cap) OVER o, 0) AS left_total, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS left_weight FROM r
  WINDOW o AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, ratio <= left_total / left_weight AS is_full FROM f),
h AS (SELECT *, min(CASE WHEN NOT is_full THEN left_total / left_weight END) OVER () AS level FROM g),
targets AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE weight * level END AS target FROM h),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sizes)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, round(target)::BIGINT - before)) + greatest(0, least(size, round(target)::BIGINT - source_size - before)))::BIGINT AS taken
FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source
"""
