"""Exact nearest vectors by cosine distance: matrix products of query blocks with slices of the stored vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Queries that one pass over the vectors carries, and stored vectors that one product takes.
QUERY_BLOCK = 1024
SLICE = 2048


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit vectors of the rows that have `dim` components, all finite and not all zero."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim)
    rows = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    size = np.sqrt((rows * rows).sum(axis=1))
    good = np.isfinite(size) & (size > 0)
    return at[good], rows[good] / size[good, None]


def firsts(found: pa.Table, k: int) -> tuple[pa.Table, np.ndarray]:
    """The k nearest of each query, in order, and every row's place among its query's."""
    found = found.sort_by([("q", "ascending"), ("distance", "ascending"), ("doc_id", "ascending")], null_placement="at_start")
    q = found["q"].to_numpy()
    place = np.arange(len(q)) - np.searchsorted(q, q, "left")
    return found.filter(pa.array(place < k)), place[place < k]


def _of_block(block: pa.Table, query_id: StructField, base: DataFrame, k: int, scoped: bool) -> DataFrame:
    """The k nearest in each task to a block's queries."""
    idents, vectors = block["query_id"].combine_chunks(), block["vector"].combine_chunks()
    dims = {n for n in pc.unique(pc.list_value_length(vectors)).to_pylist() if n}
    by_dim = {n: usable(vectors, n) for n in sorted(dims)}
    codes: dict = {}
    own = np.array([-1 if s is None else codes.setdefault(s, len(codes)) for s in block["scope"].to_pylist()] if scoped else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        bound = np.full(len(idents), np.inf)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                theirs = np.array([codes.get(s, -2) for s in part.column(2).to_pylist()]) if scoped else None
                for dim, (asks, ask_units) in by_dim.items():
                    at, units = usable(part.column(1), dim)
                    if not len(at) or not len(asks):
                        continue
                    d = np.round(1 - units @ ask_units.T, 9) + 0.0
                    if scoped:
                        d[theirs[at][:, None] != own[asks][None, :]] = np.inf
                    if len(at) >= k:
                        bound[asks] = np.minimum(bound[asks], np.partition(d, k - 1, axis=0)[k - 1])
                    r, c = np.nonzero((d <= bound[asks]) & np.isfinite(d))
                    if not len(r):
                        continue
                    found = pa.table({"q": asks[c], "distance": d[r, c], "doc_id": part.column(0).take(pa.array(at[r]))})
                    best, place = firsts(found if best is None else pa.concat_tables([best, found]), k)
                    last = np.flatnonzero(place == k - 1)
                    bound[best["q"].to_numpy()[last]] = best["distance"].to_numpy()[last]
        if best is not None:
            rows = pa.table({"query_id": idents.take(best["q"].combine_chunks()), "doc_id": best["doc_id"], "distance": best["distance"]})
            yield from rows.combine_chunks().to_batches()

    rows = base.select("doc_id", "vector", *["scope"] * scoped)
    return rows.mapInArrow(run, StructType([query_id, base.select("doc_id").schema["doc_id"], StructField("distance", DoubleType())]))


def nearest(queries: DataFrame, base: DataFrame, k: int, scoped: bool = False) -> DataFrame:
    """query_id, doc_id, distance (cosine, 9 places): each task's k nearest to every query, ties to smaller ids; a ranking of
    these gives the k nearest of all. queries(query_id, vector), base(doc_id, vector), both with a scope if `scoped`: then only
    vectors of the query's scope count, and a null one has none.

    Vectors that are null, empty, zero, of another length than the query's or with null or non-finite components take no part.
    Queries are dealt to blocks of about QUERY_BLOCK, one pass over the vectors each; a block's size does not grow with the data,
    the number of passes grows with the queries. A task puts out k rows a query at most, whatever it reads.
    """
    asks = queries.select("query_id", "vector", *["scope"] * scoped)
    head = asks.limit(QUERY_BLOCK + 1).toArrow()
    if head.num_rows <= QUERY_BLOCK:
        return _of_block(head, asks.schema["query_id"], base, k, scoped)
    blocks = -(-asks.count() // QUERY_BLOCK)
    dealt = [asks.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow() for i in range(blocks)]
    return reduce(DataFrame.unionByName, [_of_block(b, asks.schema["query_id"], base, k, scoped) for b in dealt])
