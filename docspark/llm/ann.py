"""Approximate nearest neighbours by randomly rotated one-bit codes (RaBitQ: Gao and Long, 2024).

Vectors are dealt to cells of near ones. A vector's residual to its cell's centroid is normalised, rotated at random and kept
as the signs of its components. With the residual's norm and the code's alignment to it as correction scalars, bit counts
against the query's quantised components estimate the distance, and the estimate's error bound tells which vectors can still be
among the nearest: only these are measured exactly.

A query meets its nearest cell first; the k-th distance found there is its one limit in all other cells that it probes. How
many it probes is measured on the sample that the centroids come from: as many cells as hold RECALL of the sample's true
neighbours. Where vectors lie in clusters that is a few cells; where they don't, it is most of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import join_by_key, materialize

K = 10
#: Half-width of the error bound, in standard deviations of the estimate.
BOUND = 3.0
#: Signs kept of each vector: short vectors are padded with zeros to this length before the rotation, which narrows the bound.
CODE_BITS = 512
#: Bits of a query's quantised component.
QUERY_BITS = 4
#: Vectors of one chunk of a cell and queries of one block; a task holds one of each.
CHUNK, QUERY_BLOCK = 4096, 1024
#: Vectors a cell should have, the most cells, and the sampled vectors a cell's centroid is fitted on (so at most 131,072 in all).
CELL_ROWS, MOST_CELLS, SAMPLED = 4096, 16_384, 8
#: Sampled vectors that stand in for queries when the probes are chosen, and the share of true neighbours their cells must hold.
TRIED, RECALL = 512, 0.98
FIT_ROUNDS = 8
SEED = 42


def usable(vector: Column) -> Column:
    """Not null or zero, with neither null nor non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """The rows of a random orthogonal matrix that meet components other than the padding; every task makes the same one."""
    wide = max(dim, CODE_BITS)
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([seed, wide])).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:dim]


def codes(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (rows of 64-bit words), residual norms, and the inner product of each code with its unit residual."""
    residual = (vectors - centre) @ turn
    norm = np.linalg.norm(residual, axis=1)
    unit = residual / np.where(norm > 0, norm, 1)[:, None]
    bits = unit > 0
    align = np.abs(unit).sum(axis=1) / np.sqrt(turn.shape[1])
    packed = np.packbits(bits, axis=1, bitorder="little")
    wide = np.zeros((len(bits), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view("<u8"), norm, np.where(norm > 0, align, 1.0)


def bounds(query: np.ndarray, packed: np.ndarray, norm: np.ndarray, align: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and lower bounds of the squared distances of one rotated query residual to all codes.

    The query is quantised to QUERY_BITS bits a component and its bit planes are counted against the codes:
    sum over planes of 2**j * popcount(code & plane) gives the inner product with the code's signs.
    """
    dim = len(query)
    qn = float(np.linalg.norm(query))
    if qn == 0:
        return norm**2, norm**2
    unit = query / qn
    low, width = unit.min(), max(1e-12, (unit.max() - unit.min()) / ((1 << QUERY_BITS) - 1))
    level = np.rint((unit - low) / width).astype(np.int64)
    total = np.zeros(len(packed), np.int64)
    for j in range(QUERY_BITS):
        plane = np.zeros(packed.shape[1] * 8, np.uint8)
        bits = np.packbits((level >> j & 1).astype(np.uint8), bitorder="little")
        plane[: len(bits)] = bits
        total += np.bitwise_count(packed & plane.view("<u8")).sum(axis=1, dtype=np.int64) << j
    ones = np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
    # signs are 2 * bit - 1
    product = (2 * (width * total + low * ones) - (width * level.sum() + low * dim)) / np.sqrt(dim)
    cosine = product / align
    spread = bound * np.sqrt(np.clip(1 - align**2, 0, None)) / align / np.sqrt(max(1, dim - 1)) + bound * width / np.sqrt(12) / align  # and of the query's rounding
    base, cross = norm**2 + qn**2, 2 * norm * qn
    return base - cross * cosine, base - cross * np.clip(cosine + spread, -1, 1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added in order."""
    total = np.zeros(len(vectors))
    for i in range(vectors.shape[1]):
        total += (vectors[:, i] - query[i]) ** 2
    return np.sqrt(total)


@dataclass
class Cells:
    """Centroids by vector length and the number of cells that a query probes; lengths not sampled are one cell around zero."""

    centroids: dict[int, np.ndarray]
    probes: dict[int, int]

    def of(self, dim: int) -> np.ndarray:
        return self.centroids.get(dim, np.zeros((1, dim)))

    def nearest(self, m: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest cells of each vector, nearest first."""
        c = self.of(m.shape[1])
        order = []
        for i in range(0, len(m), 1024):  # the row's own square doesn't change the order
            gap = (c**2).sum(axis=1) - 2 * m[i : i + 1024] @ c.T
            order.append(gap.argmin(axis=1)[:, None] if n == 1 else np.argsort(gap, axis=1, kind="stable")[:, :n])
        return np.concatenate(order) if order else np.zeros((0, n), np.int64)


def fit_cells(sample: dict[int, np.ndarray], cells: dict[int, int], k: int = K) -> Cells:
    """Centroids by a few rounds of k-means on the sample, and the probes that reach RECALL on it."""
    out = Cells({}, {})
    for dim, m in sample.items():
        n = max(1, min(cells[dim], len(m)))
        out.centroids[dim] = m[np.random.Generator(np.random.PCG64([SEED, dim])).choice(len(m), n, replace=False)].copy()
        for _ in range(FIT_ROUNDS if n > 1 else 0):
            own = out.nearest(m)[:, 0]
            total, count = np.zeros((n, dim)), np.bincount(own, minlength=n)
            np.add.at(total, own, m)
            out.centroids[dim] = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], out.centroids[dim])
        if n == 1:
            out.centroids[dim] = m.mean(axis=0)[None]
            out.probes[dim] = 1
            continue
        own, tried = out.nearest(m)[:, 0], m[:TRIED]
        place = np.argsort(out.nearest(tried, n), axis=1)  # of every cell in the order of each tried vector
        gap = (m**2).sum(axis=1) - 2 * tried @ m.T
        gap[np.arange(len(tried)), np.arange(len(tried))] = np.inf
        near = np.argpartition(gap, min(k, len(m) - 1) - 1, axis=1)[:, :k]
        seen = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
        out.probes[dim] = int(seen[min(len(seen) - 1, int(np.ceil(RECALL * len(seen))))]) + 1
    return out


FOUND = "query_row long, query_id long, vec_id long, score double"
INDEX = "row long, dim int, cell int, vec_id long, v array<double>, code binary, norm double, align double"


def search(vectors: DataFrame, queries: DataFrame, k: int = K, bound: float = BOUND) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest vectors but those with its own id, nearest first, ties to the smaller id.

    Both frames: vec_id, embedding. Unusable vectors (null, zero, null or non-finite components) take no part, nor do null
    ids; a query meets vectors of its own length only. Every row counts, so rows with one vec_id may all be returned, and
    every query row has an answer of its own. Empty input, empty result. Up to CELL_ROWS vectors of a length are one cell,
    and then no neighbour is missed but by the codes' bound.

    A cell's chunks and the blocks of queries that probe it meet by an equi-join; a chunk travels once for every QUERY_BLOCK
    queries of its cell. Its vectors travel with its codes: those to be measured are a share of each chunk, and fetching them
    by a join would move more.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
        return rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("v"))

    base = clean(vectors)
    counts = {r["dim"]: r["n"] for r in base.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(MOST_CELLS).collect()}
    cells = {d: max(1, min(MOST_CELLS, n // CELL_ROWS)) for d, n in counts.items()}
    wanted = SAMPLED * min(MOST_CELLS, sum(c for c in cells.values() if c > 1)) or 1
    rows = base.select("dim", "v").orderBy(F.xxhash64(F.lit(SEED), "vec_id")).limit(max(wanted, 4096)).toPandas()
    sample = {int(d): _matrix(g["v"]) for d, g in rows.groupby("dim")}
    shared = spark.sparkContext.broadcast(fit_cells(sample, {d: cells.get(d, 1) for d in sample}, k))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part in b.to_pandas().groupby("dim"):
                m = _matrix(part["v"])
                own = shared.value.nearest(m)[:, 0]
                packed, norm, align = codes(m, shared.value.of(int(dim))[own], rotation(int(dim)))
                yield pa.RecordBatch.from_pydict({"row": pa.array(part["row"], pa.int64()), "dim": pa.array(part["dim"], pa.int32()), "cell": pa.array(own, pa.int32()), "vec_id": pa.array(part["vec_id"], pa.int64()), "v": pa.array(list(m), pa.list_(pa.float64())), "code": pa.array([r.tobytes() for r in packed], pa.binary()), "norm": norm, "align": align})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part in b.to_pandas().groupby("dim"):
                m = _matrix(part["v"])
                order = shared.value.nearest(m, shared.value.probes.get(int(dim), 1))
                yield pa.RecordBatch.from_pydict({"query_row": pa.array(part["query_row"], pa.int64()), "query_id": pa.array(part["vec_id"], pa.int64()), "dim": pa.array(part["dim"], pa.int32()), "q": pa.array(list(m), pa.list_(pa.float64())), "cells": pa.array(order.tolist(), pa.list_(pa.int32()))})

    index = base.withColumn("row", F.monotonically_increasing_id()).select("row", "dim", "vec_id", "v").mapInArrow(encode, INDEX)
    index = materialize(index, "ann-index")
    asked = clean(queries).withColumn("query_row", F.monotonically_increasing_id()).select("query_row", "dim", "vec_id", "v")
    asked = materialize(asked.mapInArrow(ask, "query_row long, query_id long, dim int, q array<double>, cells array<int>"), "ann-queries")
    sizes = index.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("chunks"))
    sizes = materialize(sizes, "ann-cells")
    chunked = join_by_key(index, sizes, ["dim", "cell"], "n").withColumn("chunk", F.pmod(F.xxhash64("row"), "chunks").cast("int")).drop("n", "chunks")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}).astype({"query_row": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})
        vecs, ids = _matrix(left["v"]), left["vec_id"].to_numpy()
        packed = np.frombuffer(b"".join(left["code"]), "<u8").reshape(len(left), -1)
        norm, align = left["norm"].to_numpy(), left["align"].to_numpy()
        turn, centre = rotation(vecs.shape[1]), shared.value.of(vecs.shape[1])[int(left["cell"].iat[0])]
        out: list[tuple[np.ndarray, ...]] = []
        for qrow, qid, q, most in zip(right["query_row"], right["query_id"], right["q"], right["most"], strict=True):
            q = np.asarray(q, dtype=np.float64)
            guess, low = bounds((q - centre) @ turn, packed, norm, align, bound)
            other = ids != qid
            # the k best estimates are measured first; a vector whose lower bound is beyond all of them can't be among the nearest
            first = np.argsort(np.where(other, guess, np.inf), kind="stable")[:k]
            limit = exact(q, vecs[first[other[first]]]).max(initial=0.0) ** 2 if other.sum() > k else np.inf
            near = np.flatnonzero(other & (low <= min(limit, most**2) * (1 + 1e-9)))
            score = exact(q, vecs[near])
            best = np.lexsort((ids[near], score))[:k]
            best = best[score[best] <= most]
            out.append((np.full(len(best), qrow), np.full(len(best), qid), ids[near][best], score[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pd.DataFrame(dict(zip(("query_row", "query_id", "vec_id", "score"), cols, strict=True)))

    def measured(probes: DataFrame) -> DataFrame:
        """The k nearest in every chunk of the probed cells; probes: query_row, query_id, dim, q, cell, most."""
        keys = ["dim", "cell", "chunk", "block"]
        per = probes.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("asks"), F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK)).cast("int").alias("blocks"))
        per = materialize(per.join(sizes, ["dim", "cell"]), "ann-meets")
        right = join_by_key(probes, per, ["dim", "cell"], "asks").withColumn("block", F.pmod(F.xxhash64("query_row"), "blocks").cast("int"))
        right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*keys, "query_row", "query_id", "q", "most")
        left = join_by_key(chunked, per.select("dim", "cell", "n", "blocks"), ["dim", "cell"], "n").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        left = left.select(*keys, "vec_id", "v", "code", "norm", "align")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, FOUND)

    home = asked.select("query_row", "query_id", "dim", "q", F.col("cells")[0].alias("cell"), F.lit(float("inf")).alias("most"))
    found = materialize(measured(home), "ann-found")
    order = Window.partitionBy("query_row").orderBy("score", "vec_id")
    if max(shared.value.probes.values(), default=1) > 1:
        limit = found.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("query_row", F.col("score").alias("most"))
        away = asked.select("query_row", "query_id", "dim", "q", F.explode(F.slice("cells", 2, MOST_CELLS)).alias("cell"))
        found = found.unionByName(measured(away.join(limit, "query_row", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: Brute force.
ORACLE = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
    AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
d AS (SELECT q.r, q.vec_id AS query_id, b.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y)) AS score FROM v q JOIN v b ON q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
