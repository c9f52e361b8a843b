"""Chunkers: word windows, per section, parents and children, lines, and recursive separators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as T

SIZE, OVERLAP, SHORT = 600, 100, 100


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP, short: int = SHORT) -> Column:
    """array<struct<index, first, last, text>> of word windows; a text of under `short` words is one chunk, an empty one none."""
    step = size - overlap
    w = T.words(text)
    n = F.size(w)
    last = F.when((n < short) | (n <= size), F.lit(0)).otherwise(F.ceil((n - size) / F.lit(step)).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(
        i.alias("index"), (i * step).alias("first"), F.least(i * step + size, n).alias("last"), F.array_join(F.slice(w, i * step + 1, size), " ").alias("text"))))


def word_chunks(docs: DataFrame, ident: str = "doc_id", **how: int) -> DataFrame:
    """ident, chunk_index, first, n_words, overlap_before, overlap_after, text."""
    rows = docs.select(ident, F.explode(windows(F.col("text"), **how)).alias("c"))
    size, overlap = how.get("size", SIZE), how.get("overlap", OVERLAP)
    order = Window.partitionBy(ident).orderBy("chunk_index")
    out = rows.select(ident, F.col("c.index").alias("chunk_index"), F.col("c.first").alias("first"), (F.col("c.last") - F.col("c.first")).alias("n_words"), F.col("c.text").alias("text"))
    assert overlap < size
    return out.withColumn("overlap_before", F.when(F.col("chunk_index") == 0, 0).otherwise(overlap)).withColumn("overlap_after", F.when(F.lead("chunk_index").over(order).isNull(), 0).otherwise(overlap))


def section_chunks(docs: DataFrame, ident: str = "doc_id") -> DataFrame:
    """docs(ident, sections array<struct<title, text>>) -> ident, chunk_index (over all sections), title, text."""
    parts = docs.select(ident, F.posexplode("sections").alias("s", "section")).select(ident, "s", "section.title", F.explode(windows(F.col("section.text"))).alias("c"))
    order = Window.partitionBy(ident).orderBy("s", "i")
    return parts.select(ident, "s", "title", F.col("c.index").alias("i"), F.col("c.text").alias("text")).withColumn("chunk_index", F.row_number().over(order) - 1).select(ident, "chunk_index", "title", "text")


def parents_and_children(docs: DataFrame, url: Column, ident: str = "doc_id") -> DataFrame:
    """Parents of 1800 words (200 shared), children of 600 (100 shared); both counted over the whole document, ids by digest."""
    parents = docs.select(ident, url.alias("url"), F.explode(windows(F.col("text"), 1800, 200)).alias("p"))
    parents = parents.withColumn("parent_id", T.parent_id(F.col("url"), F.col("p.index")))
    kids = parents.select(ident, F.col("p.index").alias("parent_index"), "parent_id", F.explode(windows(F.col("p.text"))).alias("c"))
    order = Window.partitionBy(ident).orderBy("parent_index", F.col("c.index"))
    kids = kids.withColumn("child_index", F.row_number().over(order) - 1)
    return kids.select(ident, "parent_index", "parent_id", "child_index", T.child_id(F.col("parent_id"), F.col("child_index")).alias("chunk_id"), F.col("c.text").alias("text"))


def batches(docs: DataFrame, ident: str = "doc_id", most: int = 4) -> DataFrame:
    """Deal rows to min(n, most) batches of equal (ceiling) size in id order; no batch is empty.

    The ordinal comes from per-range counts, not from one global window.
    """
    n = docs.count()
    if not n:
        return docs.select(ident).withColumn("batch", F.lit(0).cast("long"))
    size = -(-n // min(n, most))
    edges = docs.agg(F.percentile_approx(ident, [i / 64 for i in range(1, 64)], 10_000)).first()[0]
    part = F.array_size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e < F.col(ident)))
    rows = docs.select(ident).withColumn("part", part)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(ident)) - 1
    return rows.withColumn("place", place).join(F.broadcast(bases), "part").select(ident, F.floor((F.col("base") + F.col("place")) / F.lit(size)).alias("batch"))


def _line_chunks(text: str, most: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    lines = text.splitlines()  # at every kind of line end
    start = 0
    while start < len(lines):
        end, size = start, 0
        while end < len(lines) and (end == start or size + len(lines[end]) + 1 <= most):
            size += len(lines[end]) + 1
            end += 1
        body = "\n".join(lines[start:end]).strip()
        if body:
            yield start + 1, end, body
        if end >= len(lines):
            return
        start = max(end - overlap, start + 1)


def line_chunks(files: DataFrame, most: int = 4000, overlap: int = 8) -> DataFrame:
    """doc_id, start_line, end_line, text: greedy windows of whole lines with up to `most` characters; the next one starts
    `overlap` lines before the end, one line further on at the least. Each step hangs on the one before, so it is a Python map."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, *c) for d, t in zip(frame["doc_id"], frame["text"], strict=True) if t is not None for c in _line_chunks(t, most, overlap)]
            yield pd.DataFrame(rows, columns=["doc_id", "start_line", "end_line", "text"])

    return files.select("doc_id", "text").mapInPandas(run, "doc_id long, start_line int, end_line int, text string")


SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split at the first separator that occurs, pieces that are still longer at the next; then join neighbours up to `size` words."""
    count = lambda s: len(s.split())
    sep = next((s for s in separators if s and s in text), "")
    rest = separators[separators.index(sep) + 1 :] if sep else ()
    pieces = text.split(sep) if sep else [text]
    out: list[str] = []
    held: list[str] = []
    for piece in pieces:
        if count(piece) > size and rest:
            if held:
                out.append(sep.join(held))
                held = []
            out += recursive_split(piece, size, overlap, rest)
            continue
        if held and count(sep.join([*held, piece])) > size:
            out.append(sep.join(held))
            while held and (count(sep.join(held)) > overlap or count(sep.join([*held, piece])) > size):
                held.pop(0)
        held.append(piece)
    if held:
        out.append(sep.join(held))
    return [x for x in (o.strip() for o in out) if x]


def recursive_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, c) for d, t in zip(frame["doc_id"], frame["text"], strict=True) if t for i, c in enumerate(recursive_split(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_index int, text string")
