"""Helpers shared by the corpus operators: table access, shared storage, byte-bounded batches and blocked groups."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (single machine only)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        if not local:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own_roots.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='docspark-')}"
        _own_roots[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and plain path behind a URI, usable in tasks."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


@lru_cache(maxsize=256)
def shared_array(uri: str, kind: str) -> np.ndarray:
    """A read-only array in a file of the shared folder: mapped where the folder is mounted, so a node's workers share one
    copy; else read once a worker."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        whole = np.memmap(path, dtype="u1", mode="r")
    else:
        with fs.open_input_stream(path, compression=None) as f:
            whole = np.frombuffer(f.read(), "u1")
    size = np.dtype(kind).itemsize
    return whole[: len(whole) // size * size].view(kind)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array with at most `limit` bytes each (a longer row stands alone)."""
    n = len(texts)
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()))
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    yield start, n


def tasks(spark: SparkSession) -> int:
    """Partitions for heavy per-row work: the session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows from which on a key counts as hot, and hot keys that are broadcast (a table of n rows has at most n / HOT_ROWS of them).
HOT_ROWS, BROADCAST_KEYS = 1024, 500_000


def join_by_key(rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, hot: int = HOT_ROWS) -> DataFrame:
    """rows with the columns of per_key (one row a key, `n` rows each): an inner join that puts no hot key in one task.

    Rows of hot keys stay where they are, since those keys are broadcast; all others are joined on the key. Where the hot
    keys themselves are too many to broadcast, adaptive execution has to split them.
    """
    big = per_key.where(F.col(n) > hot)
    some = big.limit(BROADCAST_KEYS + 1).count()
    if not some or some > BROADCAST_KEYS:
        return rows.join(per_key, keys)
    more = [c for c in per_key.columns if c not in keys]
    marked = rows.join(F.broadcast(big.select(*keys, F.struct(*more).alias("_hot"))), keys, "left")
    warm = marked.where("_hot is not null").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in more])
    cold = marked.where("_hot is null").drop("_hot").join(per_key.where(F.col(n) <= hot), keys)
    return warm.unionByName(cold.select(*warm.columns))


def in_blocks(df: DataFrame, keys: list[str], salt: Column, size: int, weight: Column | None = None, most: int = 0, deal: bool = True) -> DataFrame:
    """Deal the rows of each key group to blocks so that all pairs of rows meet and no task holds a whole large group.

    A group of n rows gets m = ceil(n / size) sub-blocks, or as many as its weight has times `most`; a row of sub-block s
    goes to the m block pairs (min(s, t), max(s, t)). Adds `bi`, `bj` (the pair) and `sub` (the row's own sub-block); groups
    of one row are left out. Every pair of rows meets exactly once if rows with sub = bi are paired with rows with sub = bj.
    The blocks are dealt by key and pair, not by key alone; without `deal` that is left to the caller.
    """
    m = F.ceil(F.count(F.lit(1)) / F.lit(size))
    if weight is not None:
        m = F.greatest(m, F.ceil(F.sum(weight) / F.lit(most)))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), m.cast("int").alias("_m")).where("_n > 1")
    rows = (
        join_by_key(df, sizes, keys, "_n")
        .withColumn("sub", F.pmod(salt, "_m").cast("int"))
        .withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
        .withColumn("bi", F.least("sub", "_t"))
        .withColumn("bj", F.greatest("sub", "_t"))
        .drop("_t", "_n", "_m")
    )
    # a number, as adaptive execution would merge rows so small into one task, whatever their pairs cost
    return rows.repartition(tasks(df.sparkSession), *keys, "bi", "bj") if deal else rows


#: Most range buckets whose edges are kept as literals; beyond, buckets grow and their sorts spill.
MOST_BUCKETS = 8192


def range_buckets(rows: DataFrame, column: str, per: int) -> DataFrame:
    """Adds `bucket`: the number of the range of `column` that a row is in, about `per` rows each, nulls in bucket 0.

    The edges are searched in two steps, so a row costs about the square root of their number.
    """
    parts = min(MOST_BUCKETS, -(-rows.count() // per))
    edges: list = []
    if parts > 1:
        cuts = F.percentile_approx(column, [i / parts for i in range(1, parts)], max(10_000, 20 * parts))
        edges = sorted(set(rows.where(F.col(column).isNotNull()).agg(cuts).first()[0] or []))
    if not edges:
        return rows.withColumn("bucket", F.lit(0))
    step = math.isqrt(len(edges) - 1) + 1

    def below(some: Column) -> Column:
        return F.array_size(F.filter(some, lambda e: e < F.col(column)))

    coarse = below(F.array(*map(F.lit, edges[step - 1 :: step])))
    fine = below(F.slice(F.array(*map(F.lit, edges)), F.col("_coarse") * step + 1, F.lit(step)))
    return rows.withColumn("_coarse", F.coalesce(coarse, F.lit(0))).withColumn("bucket", F.coalesce(F.col("_coarse") * step + fine, F.lit(0))).drop("_coarse")
