"""Token-id files: documents in ascending doc_id, tokenised once, coded in independent rANS blocks and read back in parallel.

Three passes, each over files in the shared folder, so a lost executor only repeats its own task:
ids of a doc_id range to one plain file, with a histogram; from all histograms one frequency table; blocks coded with it, with
an index row each. Readers decode any block (or any checkpoint's part of one) from its index row alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm import rans
from docspark.llm.common import filesystem, materialize, shared_path, text_slices
from docspark.llm.tokens import batch_tokenizer, tokenizer_path

END_ID = 0
#: Documents of one range file; ids of a block (whole documents, so the last one may pass it).
BUCKET_ROWS = 2048
BLOCK_IDS = 1 << 20
#: Most range files; beyond, a file has more documents.
MOST_PARTS = 100_000

PLAIN = "bucket int, file string, n_docs long, n_ids long, counts binary"
INDEX = "bucket int, block int, file string, offset long, length long, n_docs long, n_ids long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


class _PlainFile:
    """One range's ids in document order, as record batches of whole documents."""

    def __init__(self, folder: str, bucket: int):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.bucket, self.name = bucket, f"ids-{uuid.uuid4().hex}.arrow"
        self.sink = self.fs.open_output_stream(f"{base}/{self.name}", compression=None)
        self.writer = pa.ipc.new_stream(self.sink, _SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        self.docs = self.ids = 0
        self.counts = np.zeros(0, np.int64)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, n: np.ndarray) -> None:
        bounds = np.concatenate(([0], np.cumsum(n))).tolist()
        small = ids.astype("<u4")
        cells = [small[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        self.writer.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(cells, pa.binary())], schema=_SCHEMA))
        got = np.bincount(ids)
        if len(got) > len(self.counts):
            got[: len(self.counts)] += self.counts
            self.counts = got
        else:
            self.counts[: len(got)] += got
        self.docs += len(n)
        self.ids += len(ids)

    def close(self, folder: str) -> pa.RecordBatch:
        self.writer.close()
        self.sink.close()
        counts = zlib.compress(self.counts.astype("<i8").tobytes(), 1)
        return pa.RecordBatch.from_pydict({"bucket": pa.array([self.bucket], pa.int32()), "file": [f"{folder}/{self.name}"], "n_docs": [self.docs], "n_ids": [self.ids], "counts": pa.array([counts], pa.binary())})


def tokenise(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the plain files, one a range partition of the documents; one row each. Equal doc_ids may lie in several."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("at"))
    parts = min(MOST_PARTS, max(1, -(-docs.count() // BUCKET_ROWS)))
    order = [F.asc_nulls_first("doc_id"), "at"]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, out = batch_tokenizer(path, plain=False), None
        for batch in batches:
            for i, j in text_slices(batch.column(1)):
                b = batch.slice(i, j - i)
                if out is None:  # the number of a range partition is its place in the order
                    out = _PlainFile(folder, TaskContext.get().partitionId())
                ids, n = tok.encode(b.column(1))
                out.add(b.column(0), np.insert(ids, np.cumsum(n), end_id), n + 1)
        if out is not None:
            yield out.close(folder)

    return ordered.select("doc_id", "text").mapInArrow(run, PLAIN)


def frequency_table(plain: DataFrame) -> np.ndarray:
    """Scaled frequencies of all ids; the counts are added up by id on the cluster, so the driver gets one row an id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0).to_pylist():
                counts = np.frombuffer(zlib.decompress(c), "<i8")
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["id", "n"])

    rows = plain.select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    if rows.empty:
        return np.zeros(1, np.uint32)
    counts = np.zeros(int(rows["id"].max()) + 1)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return rans.scaled(counts)


def encode_files(plain: DataFrame, frequencies: np.ndarray, folder: str) -> DataFrame:
    """Code every plain file to one block file; the index, one row a block.

    A block: 4 bytes number of documents, their ids (8 bytes) and lengths (4 bytes), checksum of these, then the coded ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(frequencies)
        for batch in batches:
            for row in batch.to_pylist():
                fs, source = filesystem(row["file"])
                _, base = filesystem(folder)
                fs.create_dir(base, recursive=True)
                name = f"block-{uuid.uuid4().hex}.rans"
                index: list[tuple] = []
                at = 0
                with fs.open_input_stream(source, compression=None) as f, fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                    docs: list = []
                    lens: list[int] = []
                    cells: list[bytes] = []
                    total = 0

                    def block() -> bytes:
                        head = struct.pack("<I", len(docs)) + np.array([-1 if d is None else d for d in docs], "<i8").tobytes() + np.array(lens, "<u4").tobytes() + np.packbits([d is None for d in docs]).tobytes()
                        return head + struct.pack("<I", zlib.crc32(head)) + rans.encode(np.frombuffer(b"".join(cells), "<u4"), table)

                    for b in pa.ipc.open_stream(f):
                        for d, n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                            docs.append(d), lens.append(n), cells.append(ids.as_py())
                            total += n
                            if total >= BLOCK_IDS:
                                data = block()
                                out.write(data)
                                index.append((at, len(data), len(docs), total))
                                at += len(data)
                                docs, lens, cells, total = [], [], [], 0
                    if docs:
                        data = block()
                        out.write(data)
                        index.append((at, len(data), len(docs), total))
                n = len(index)
                cols = list(zip(*index, strict=True)) if n else [[], [], [], []]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([row["bucket"]] * n, pa.int32()), "block": pa.array(range(n), pa.int32()), "file": pa.array([f"{folder}/{name}"] * n, pa.string()), "offset": pa.array(cols[0], pa.int64()), "length": pa.array(cols[1], pa.int64()), "n_docs": pa.array(cols[2], pa.int64()), "n_ids": pa.array(cols[3], pa.int64())})

    # rows are names of files: left to adaptive execution, such small partitions would all be merged into one task
    return plain.select("bucket", "file").repartition(max(1, plain.count()), "file").mapInArrow(run, INDEX)


DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_block(data: bytes, table: rans.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, lengths and ids of a block."""
    (n,) = struct.unpack_from("<I", data)
    size = 4 + 12 * n + -(-n // 8)
    if zlib.crc32(data[:size]) != struct.unpack_from("<I", data, size)[0]:
        raise ValueError("a block's head does not have its checksum")
    docs = np.frombuffer(data, "<i8", n, 4).tolist()
    lens = np.frombuffer(data, "<u4", n, 4 + 8 * n).astype(np.int64)
    void = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), 4 + 12 * n), count=n)
    return [None if v else d for d, v in zip(docs, void.tolist(), strict=True)], lens, rans.decode(data[size + 4 :], table)


def read_files(index: DataFrame, frequencies: np.ndarray) -> DataFrame:
    """One row a document from the block files: start counts the ids of all documents before it."""
    files = index.groupBy("bucket").agg(F.sum("n_ids").alias("all_ids"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("bucket", F.coalesce(F.sum("all_ids").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = index.withColumn("inner", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(bases, "bucket").withColumn("start", F.col("base") + F.col("inner"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(frequencies)
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = filesystem(row["file"])
                with fs.open_input_file(path) as f:
                    docs, lens, ids = read_block(f.read_at(row["length"], row["offset"]), table)
                ends = np.cumsum(lens)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(row["start"] + ends - lens), pa.array(lens), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = index.agg(F.count_distinct("bucket")).first()[0]  # as in encode_files(): a row stands for a whole block
    return placed.select("file", "offset", "length", "start").repartition(max(1, parts), "file", "offset").mapInArrow(run, DECODED)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write all documents and read them back; doc_id, start, n_tokens, ids_crc32.

    A null text is empty and has its end id alone; rows with one doc_id stand in the order they are read, null ids come first;
    an empty table gives an empty result; columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "tokens")
    plain = materialize(tokenise(docs, f"{folder}/plain", path or tokenizer_path()), "tokens-plain")
    frequencies = frequency_table(plain)
    index = materialize(encode_files(plain, frequencies, f"{folder}/blocks"), "tokens-index")
    fs, base = filesystem(f"{folder}/plain")
    if fs.get_file_info(base).type.name == "Directory":
        fs.delete_dir(base)
    return read_files(index, frequencies)
