"""Near-duplicates by b-bit MinHash: banded candidates, collision-corrected estimates by bit counts, links on full sets.

1. One pass over the texts: set size, digest of the set, the minima of HASHES permutations, their low BITS packed, band keys.
2. Documents with equal sets form a class; only the class's smallest document goes on.
3. Every band bucket links its members to its smallest one: candidates in proportion to the bucket, checked on full sets.
4. Components of these links. In buckets that still hold several, members outside the main one are checked with their
   likeliest partners in others, for a few rounds; at last, block by block, all pairs of different components that the
   estimate lets through are counted on full sets, and only links that join components leave the block.
   Members of one component need no further check, so large groups of near copies cost in proportion to their size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import in_blocks, join_by_key, materialize, text_slices
from docspark.llm.graphs import components
from docspark.llm.shingles import mix64, shingle_sets

#: Minima a document keeps; rows of a band. A pair at 0.75 is missed by all bands with probability 1e-5.
HASHES, ROWS = 128, 4
BITS = 4
#: Link at 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Estimates under the threshold by more than this many standard deviations are not checked on full sets.
DEVIATIONS = 5.0
#: Members of a bucket that one task compares at once, and the bytes of their full sets; ids up to which a semi-join side is broadcast (16 bytes each).
BLOCK, BLOCK_BYTES, BROADCAST_IDS = 2048, 16 << 20, 1_000_000
#: Rounds in which each member outside its bucket's main component names its BEST likeliest partners, before all pairs of what is left.
ROUNDS, BEST = 2, 3

_rng = np.random.Generator(np.random.PCG64(20240607))
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        out = np.minimum(out, (shingles[i : i + 4096, None] * _A + _B).min(axis=0))
    return out


def pack(mins: np.ndarray) -> bytes:
    """The low BITS of each minimum, bit plane by bit plane."""
    low = (mix64(mins) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return b"".join(np.packbits((low >> p) & 1).tobytes() for p in range(BITS))


def planes(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), "<u8").reshape(len(signatures), BITS, HASHES // 64)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Jaccard estimates from packed signatures: the share of equal minima, corrected for the 2**-BITS that agree by chance."""
    differ = np.bitwise_or.reduce(one ^ many, axis=-2)
    same = HASHES - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-BITS
    return (same / HASHES - chance) / (1 - chance)


def least_estimate(percent: int = PERCENT) -> float:
    chance, at = 2.0**-BITS, percent / 100
    p = chance + (1 - chance) * at
    return at - DEVIATIONS * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary"


def sketch(docs: DataFrame) -> DataFrame:
    """One row a document; documents without words have no digest, bands or signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
        for b in batches:
            for i, j in text_slices(b.column(1)):
                sizes, digests, bands, sigs = [], [], [], []
                for s in shingle_sets(b.column(1).slice(i, j - i)):
                    sizes.append(len(s))
                    if not len(s):
                        digests.append(None), bands.append(None), sigs.append(None)
                        continue
                    mins = minima(s)
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sigs.append(pack(mins))
                    rows = mins.reshape(-1, ROWS)
                    key = np.arange(len(rows), dtype=np.uint64)
                    for r in range(ROWS):
                        key = mix64(key ^ rows[:, r])
                    bands.append(key.view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents with their id in ids(doc_id): the ids are broadcast only when few."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets link them. Whole texts travel to the pair, their sets are made there."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = _among(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null"), ids)
    full = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, np.zeros(0, np.uint64)
        for batch in batches:
            for i, j in text_slices(batch.column(2)):
                part = batch.slice(i, j - i)
                others = shingle_sets(part.column(2))
                keep = []
                for k, (a, text) in enumerate(zip(part.column(0).to_pylist(), part.column(3), strict=True)):
                    if a != last:
                        last, kept = a, shingle_sets(pa.array([text.as_py()]))[0]
                    common = len(np.intersect1d(kept, others[k], assume_unique=True))
                    keep.append(100 * common >= percent * (len(kept) + len(others[k]) - common) and common > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.select("a", "b", "text_b", "text_a").mapInArrow(run, "a long, b long")


def _estimated(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs whose estimate is at least `least`."""
    both = pairs.join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (planes(b.column(c).to_pylist()) for c in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(estimate(x, y) >= least))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _likeliest(rows: DataFrame, least: float, best: int) -> DataFrame:
    """Pairs of different labels in one bucket; rows: bucket, doc_id, label, sig.

    Members outside the block's most frequent label name their `best` likeliest partners by estimate, so the pairs are in
    proportion to the members.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("doc_id")
        one_block = frame["bi"].iat[0] == frame["bj"].iat[0]
        labels, counts = np.unique(frame["label"].to_numpy(), return_counts=True)
        main = labels[counts.argmax()]
        sides = [frame[frame["sub"] == frame["bi"]], frame[frame["sub"] == frame["bj"]]]
        out_a: list[int] = []
        out_b: list[int] = []
        for left, right in [sides] if one_block else [sides, sides[::-1]]:
            asks = left[left["label"] != main]
            if not len(asks) or not len(right):
                continue
            many, ids, own = planes(list(right["sig"])), right["doc_id"].to_numpy(), right["label"].to_numpy()
            for doc, label, sig in zip(asks["doc_id"], asks["label"], planes(list(asks["sig"])), strict=True):
                other = np.flatnonzero(own != label)
                guess = estimate(sig, many[other])
                hit = np.flatnonzero(guess >= least)
                hit = hit[np.argsort(-guess[hit], kind="stable")[:best]]
                out_a += [doc] * len(hit)
                out_b += ids[other[hit]].tolist()
        a, b = np.array(out_a, np.int64), np.array(out_b, np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    blocks = in_blocks(rows, ["bucket"], F.xxhash64("doc_id"), BLOCK)
    return blocks.groupBy("bucket", "bi", "bj").applyInPandas(run, "a long, b long").distinct()


def _full_sets(texts: DataFrame) -> DataFrame:
    """doc_id, set (sorted 64-bit shingle hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in text_slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([s.tobytes() for s in shingle_sets(b.column(1).slice(i, j - i))], pa.binary())], names=["doc_id", "set"])

    return texts.mapInArrow(run, "doc_id long, set binary")


def _all_links(rows: DataFrame, docs: DataFrame, least: float, percent: int) -> DataFrame:
    """Confirmed links that join different labels in one bucket; rows: bucket, doc_id, label, sig, bands, n_shingles.

    Full sets, made once a document, come to the block, and every pair of different components that the estimate lets through
    is counted there, in the first bucket where the two meet. Only links that join components leave a block, fewer than its
    members.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    sets_of = materialize(_full_sets(_among(texts, rows.select("doc_id").distinct())), "minhash-sets")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n = len(frame)
        ids, comp, sub = frame["doc_id"].to_numpy(), np.unique(frame["label"].to_numpy(), return_inverse=True)[1], frame["sub"].to_numpy()
        bi, bj = frame["bi"].iat[0], frame["bj"].iat[0]
        sigs, bands = planes(list(frame["sig"])), np.stack(frame["bands"].to_list())
        band = int(np.flatnonzero(bands[0] == frame["bucket"].iat[0])[0])
        sets = [np.frombuffer(x, "<u8") for x in frame["set"]]
        sizes = np.fromiter(map(len, sets), np.int64, n)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        known, flat = np.unique(np.concatenate(sets), return_inverse=True)
        has = np.zeros(len(known), bool)
        out: list[tuple[int, int]] = []
        for i in range(n):
            if sub[i] != bi:
                continue
            other = np.flatnonzero((comp != comp[i]) & (sub == bj) & ((np.arange(n) > i) | (bi != bj)))
            other = other[estimate(sigs[i], sigs[other]) >= least] if len(other) else other
            if band and len(other):
                other = other[~(bands[other, :band] == bands[i, :band]).any(axis=1)]
            if not len(other):
                continue
            has[flat[bounds[i] : bounds[i + 1]]] = True
            for j in other.tolist():
                if comp[j] == comp[i]:
                    continue
                common = int(has[flat[bounds[j] : bounds[j + 1]]].sum())
                if common and 100 * common >= percent * (sizes[i] + sizes[j] - common):
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    comp[comp == comp[j]] = comp[i]
            has[flat[bounds[i] : bounds[i + 1]]] = False
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    blocks = in_blocks(rows, ["bucket"], F.xxhash64("doc_id"), BLOCK, F.col("n_shingles") * 8, BLOCK_BYTES, deal=False).drop("n_shingles").join(sets_of, "doc_id")
    return blocks.groupBy("bucket", "bi", "bj").applyInPandas(run, "a long, b long").distinct()


def _bridges(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels (u, v) that links (a, b) join."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    return ends.select(F.coalesce("la", "a").alias("u"), F.coalesce("lb", "b").alias("v")).where("u <> v").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach), kept (doc_id = component_id).

    Texts that are null or have no words have no shingles and link with nothing. Rows with the same doc_id are one document:
    what either links with is one component. A null doc_id has a null component. Empty tables give empty results; columns
    other than doc_id and text are not read.
    """
    least = least_estimate(percent)
    rows = materialize(sketch(docs), "minhash-sketch")
    real = rows.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(real.groupBy("digest").agg(F.min("doc_id").alias("rep")), "minhash-classes")
    chosen = materialize(real.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "bands", "sig", "n_shingles"), "minhash-chosen")
    members = chosen.select("doc_id", F.explode("bands").alias("bucket"))
    hubs = members.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("far"), F.count(F.lit(1)).alias("n")).where("hub < far").drop("far")
    sigs = chosen.select("doc_id", "sig")
    placed = materialize(join_by_key(members, hubs, ["bucket"], "n").drop("n"), "minhash-buckets")
    stars = placed.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = materialize(_estimated(stars, sigs, least), "minhash-stars")
    linked = materialize(confirmed(stars, docs, percent), "minhash-links")
    copies = real.join(classes, "digest").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    repeated = copies.join(chosen.select(F.col("doc_id").alias("u")).distinct(), "u", "left_semi")  # an id with several sets
    labels = materialize(components(linked.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(repeated)), "minhash-labels")
    tested, best = stars, BEST
    for step in range(ROUNDS + 1):
        labelled = materialize(placed.join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("label", "doc_id").alias("label")), "minhash-labelled")
        several = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi and n > 2").select("bucket", "n")
        apart = materialize(join_by_key(labelled, several, ["bucket"], "n").drop("n").join(chosen, "doc_id").select("bucket", "doc_id", "label", "sig", *(["bands", "n_shingles"] if best is None else [])), "minhash-apart")
        last = best is None
        if last:
            found = _all_links(apart, docs, least, percent)
        else:
            pairs = materialize(_likeliest(apart, least, best).join(tested, ["a", "b"], "left_anti"), "minhash-across")
            tested = tested.unionByName(pairs)
            found = confirmed(pairs, docs, percent)
        bridges = materialize(_bridges(found, labels), "minhash-bridges")
        if step == ROUNDS - 1 or bridges.isEmpty():
            best = None
        if not bridges.isEmpty():
            over = materialize(components(bridges), "minhash-merged")
            members_of = labels.unionByName(over.select("node", F.col("node").alias("label")).join(labels.select("node"), "node", "left_anti"))
            labels = materialize(members_of.join(over.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label")), "minhash-labels")
        if last:
            break
    final = (
        classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
        .select("digest", F.coalesce("label", "rep").alias("component_id"))
    )
    joined = rows.join(final, "digest", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with the columns of `docs`: the first by doc_id (null last), then by a digest of all values.

    Near-duplicates are decided by row here, so different texts under one doc_id, or under none, are documents of their own.
    Rows without words link with nothing: of those with equal doc_id and text one stays, of those with a null doc_id all.
    The documents travel as one struct, so columns of any names keep their values.
    """
    keyed = materialize(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*docs.columns).alias("_doc")), "minhash-rows")
    doc_id, text = F.col("_doc.doc_id"), F.col("_doc.text")
    report = near_duplicates(keyed.select(F.col("_row").alias("doc_id"), text.alias("text")), percent)
    linked = report.select(F.col("doc_id").alias("_row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("_group"))
    whole = F.sha2(F.to_json("_doc"), 256)
    # a group is a component; without words, a doc_id and text; else the row itself
    wordless = F.when(doc_id.isNull(), F.concat(F.lit("row "), F.col("_row").cast("string"))).otherwise(F.sha2(F.to_json(F.struct(doc_id.alias("doc_id"), text.alias("text"))), 256))
    ranked = keyed.select("_row", F.struct(doc_id.isNull().alias("n"), doc_id.alias("i"), whole.alias("w"), F.col("_row").alias("r")).alias("_rank"), wordless.alias("_own"))
    groups = ranked.join(linked, "_row").withColumn("_own", F.when(F.col("_group").isNull(), F.col("_own")))
    kept = groups.groupBy("_group", "_own").agg(F.min("_rank").alias("_first")).select(F.col("_first.r").alias("_row"))
    return keyed.join(kept, "_row", "left_semi").select(*[F.col(f"_doc.`{c}`") for c in docs.columns])
