"""WARC archives written and read index first.

Each writing task makes one archive file and yields, for every record, its file, offset, length, URL and digest. Readers pick
records from that index alone, sort them by file and offset, coalesce neighbours into byte ranges, and fetch only those.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import filesystem, materialize, shared_path

#: Neighbouring records this near are fetched in one read, up to RANGE_BYTES at once.
GAP_BYTES = 64 << 10
RANGE_BYTES = 8 << 20
#: Most partitions of a read; beyond, a task fetches several ranges one after the other.
MOST_PARTS = 100_000
#: Payloads from this size on are kept once; later ones refer to it.
MIN_REVISIT_BYTES = 0

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long, payload_bytes long"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, from the hexadecimal one: five hex digits give four base32 characters."""
    hexed = F.sha1(payload)
    parts = []
    for i in range(8):
        v = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(v, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*parts)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to: of equal payloads of at least min_bytes the smallest page_id is the response."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", digest(F.col("payload")))
    # digests alone travel for the grouping; only the digests that repeat are joined back
    firsts = (
        rows.where(F.length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("d2"), "first_id")
    )
    joined = rows.join(firsts, (F.col("digest") == F.col("d2")) & (F.length("payload") >= min_bytes), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).alias("refers_to"))


def _record(page_id: int | None, url: str | None, payload: bytes, digest32: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').replace(chr(13), ' ').replace(chr(10), ' ')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest32}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is None:
        body = payload
    else:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        body = b""
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 4, mtime=0)


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write every row of with_revisits() as a record of its own gzip member; the index, one row a record.

    A task's file has a name of its own and counts only once the task's index rows are committed, so tasks may be run again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        try:
            for b in batches:
                ids, urls, digests, refers = (b.column(i).to_pylist() for i in (0, 1, 3, 4))
                offsets, lengths, sizes = [], [], []
                if b.num_rows and out is None:
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                for i, payload in enumerate(b.column(2)):
                    data = payload.as_py()
                    record = _record(ids[i], urls[i], data, digests[i], refers[i])
                    out.write(record)
                    offsets.append(at)
                    lengths.append(len(record))
                    sizes.append(len(data))
                    at += len(record)
                kinds = ["response" if r is None else "revisit" for r in refers]
                yield pa.RecordBatch.from_pydict({
                    "file": [f"{folder}/{name}"] * b.num_rows, "offset": offsets, "length": lengths, "url": urls, "digest": digests,
                    "page_id": pa.array(ids, pa.int64()), "record_type": kinds, "refers_to": pa.array(refers, pa.int64()), "payload_bytes": pa.array(sizes, pa.int64()),
                }, schema=pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64())]))
        finally:
            if out is not None:
                out.close()

    return rows.mapInArrow(write, INDEX)


def byte_ranges(index: DataFrame, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> DataFrame:
    """file, start, stop, records: sorted reads that cover the index's records, with gaps of at most `gap` bytes inside a read.

    A read starts where the gap to the record before is larger, or where a new piece of `most` bytes of the file begins.
    """
    order = Window.partitionBy("file").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(order)
    piece = F.floor(F.col("offset") / F.lit(most))
    new = (before.isNull() | (F.col("offset") - before > gap) | (piece != F.lag(piece).over(order))).cast("int")
    runs = index.select("file", "offset", "length").withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("file", "run").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records")).drop("run")


RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record's length does not fit its content")
    return fields, rest[:size]


def dealt(ranges: DataFrame, index: DataFrame, most: int = RANGE_BYTES) -> DataFrame:
    """The ranges over as many partitions as their records fill reads of `most` bytes; left without a number, such small rows would all be merged into one task."""
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return ranges.repartition(min(MOST_PARTS, max(1, -(-int(size) // most))), "file", "start")


def read_records(ranges: DataFrame, payloads: bool = True) -> DataFrame:
    """The records inside byte ranges. A response's payload is checked against its digest; a revisit has none of its own."""

    def number(urn: str | None) -> int | None:
        text = (urn or "")[len("<urn:page:") : -1]
        return int(text) if text else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, path = filesystem(r["file"])
                with fs.open_input_file(path) as f:
                    data = f.read_at(r["stop"] - r["start"], r["start"])
                out: dict[str, list] = {k: [] for k in ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")}
                for record in r["records"]:
                    at = record["offset"] - r["start"]
                    fields, body = parse_record(data[at : at + record["length"]])
                    want = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != want:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
                    for k, v in (("page_id", number(fields["WARC-Record-ID"])), ("url", fields["WARC-Target-URI"]), ("record_type", fields["WARC-Type"]), ("refers_to", number(fields.get("WARC-Refers-To"))), ("payload_digest", want), ("payload_bytes", int(fields["X-Payload-Length"])), ("payload", body if payloads else None)):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]))

    return ranges.mapInArrow(read, RECORD)


def archive(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write all pages and return the committed index.

    A null html is an empty payload; a null url an empty one; equal payloads (the empty one too) of one page_id are all
    responses; rows with a null page_id are responses; an empty table gives an empty index; other columns are not read.
    """
    spark = pages.sparkSession
    return materialize(write_archives(with_revisits(pages, min_bytes), shared_path(spark, "warc")), "warc-index")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read all records back through the index; one row a record, as the archives have it."""
    index = archive(pages)
    return read_records(dealt(byte_ranges(index), index), payloads=False).drop("payload", "url")


def lookup(index: DataFrame, selected: DataFrame) -> DataFrame:
    """Records of the selected URLs or digests (a frame with column url or digest): index join, then coalesced reads."""
    key = "url" if "url" in selected.columns else "digest"
    chosen = index.join(selected.select(key).distinct(), key, "left_semi")
    return read_records(dealt(byte_ranges(chosen), chosen))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload, h,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4)))::BIGINT & 31)::BIGINT + 1, 1)), '') AS payload_digest,
  min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
