"""Stored keyword indexes: postings in blocks with score bounds, searched by reading only the blocks that can matter.

An index is a version's folder: `postings` (a row a term and segment of documents, range-partitioned by term), `lengths` (a row
a document) and `stats` (one row). A segment is a range of documents in doc_id order, so the blocks of all terms line up, and the sum of a
query's block bounds in a segment bounds the score of every document in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators.retrieval import few, query_terms, top_k
from docspark.session import kept
from docspark.sources.readers import read_version, versions, write_version

#: Documents of a segment.
SEGMENT = 8
K1, B = 1.2, 0.75


#: Documents that are taken apart at once.
SLICE = 512
BLOCK = "segment long, term string, docs array<struct<doc_id:long,tf:int,dl:int>>"


def _blocks(docs: DataFrame, segment: int) -> DataFrame:
    """Every segment's blocks, a row a term, and a row without a term with all its documents; docs: doc_id, terms.

    Documents are dealt by ranges of doc_id, and a task numbers the segments of its range, so the blocks need no shuffle.
    """

    def taken_apart(rows: pa.Table, part: int, first: int) -> pa.RecordBatch:
        terms = rows["terms"].combine_chunks()
        ids, dl = rows["doc_id"].combine_chunks(), pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        words = terms.flatten().dictionary_encode()
        size, owner = len(words.dictionary) + 1, np.repeat(np.arange(len(dl)), dl)
        # the last code stands for the document itself
        codes = np.append(words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.full(len(dl), size - 1))
        owner = np.append(owner, np.arange(len(dl)))
        own, inside = np.divmod(owner, segment)
        keys, tf = np.unique((own * size + codes) * segment + inside, return_counts=True)
        block, inside = np.divmod(keys, segment)
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        own, code = np.divmod(block, size)
        at = own * segment + inside
        entries = pa.StructArray.from_arrays([ids.take(pa.array(at)), pa.array(tf.astype(np.int32)), pa.array(dl[at].astype(np.int32))], names=["doc_id", "tf", "dl"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)).astype(np.int32)), entries)
        term = words.dictionary.take(pa.array(code[starts], mask=code[starts] == size - 1))
        return pa.RecordBatch.from_arrays([pa.array((part << 33) + first + own[starts]), term, lists], names=["segment", "term", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, part, number, step = None, 0, 0, -(-SLICE // segment) * segment
        for b in batches:
            for i in range(0, b.num_rows, step):
                part, some = b.column(2)[0].as_py(), pa.Table.from_batches([b.slice(i, step)])
                left = some if left is None else pa.concat_tables([left, some])
                whole = len(left) // segment * segment
                if whole:
                    yield taken_apart(left.slice(0, whole), part, number)
                    number, left = number + whole // segment, left.slice(whole)
        if left is not None and len(left):
            yield taken_apart(left, part, number)

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows = ranged.select(F.col("doc_id").cast("long"), T.terms(F.coalesce(F.col("text"), F.lit(""))).alias("terms"), F.spark_partition_id().cast("long").alias("part"))
    return rows.mapInArrow(run, BLOCK)


def tables(docs: DataFrame, segment: int = SEGMENT) -> dict[str, DataFrame]:
    """The tables of an index over documents (doc_id, text; a null text has no terms).

    postings: term, segment, docs (doc_id, tf, impact of each), bound (the greatest impact), df. An impact is a posting's BM25
    weight, so a query's score is a sum of impacts and a bound needs no document.
    """
    rows = kept(_blocks(docs, segment))
    lengths = rows.where("term is null").select("segment", F.explode("docs").alias("d")).select("d.doc_id", "segment", "d.dl")
    stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))
    # the one shuffle of the blocks: a term's are in one range, where they are counted in the order in which they are written
    of_term = Window.partitionBy("term").orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = rows.where("term is not null").repartitionByRange("term").withColumn("df", F.sum(F.size("docs")).over(of_term))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))

    def impact(p):
        return F.struct(p["doc_id"].alias("doc_id"), p["tf"].cast("long").alias("tf"), (idf * p["tf"] * (K1 + 1) / (p["tf"] + K1 * (1 - B + B * p["dl"] / F.col("avg_dl")))).alias("impact"))

    weighed = blocks.crossJoin(F.broadcast(stats)).withColumn("docs", F.transform("docs", impact))  # stats: one row
    postings = weighed.select("term", "segment", "docs", F.array_max(F.transform("docs", lambda p: p["impact"])).alias("bound"), "df")
    return {"postings": postings.sortWithinPartitions("term", "segment"), "lengths": lengths, "stats": stats}


def build(docs: DataFrame, folder: str, version: int, segment: int = SEGMENT) -> bool:
    """Write a version of the index; False, and nothing written, where that version is complete already."""
    return write_version(tables(docs, segment), folder, version)


def probe(spark: SparkSession, folder: str) -> dict[str, int | bool | None]:
    """Does an index exist, which version is read, and how many documents, terms and blocks does it have?"""
    found = versions(spark, folder)
    if not found:
        return {"exists": False, "version": None, "documents": 0, "terms": 0, "blocks": 0}
    own = read_version(spark, folder, found[-1], ["postings", "stats"])
    blocks = own["postings"].agg(F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("terms")).first()
    return {"exists": True, "version": found[-1], "documents": own["stats"].first()["n_docs"], "terms": blocks["terms"], "blocks": blocks["n"]}


def block_bounds(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, segment, bound: the most that any document of the segment can score, from the blocks' heads alone."""
    terms = few(query_terms(queries), 1_000_000)
    return postings.select("term", "segment", "bound").join(terms, "term").groupBy("query_id", "segment").agg(F.sum("bound").alias("bound"))


def _scores(queries: DataFrame, postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exact scores of all documents in the wanted segments (query_id, segment); a query's term counts once, however often it is asked."""
    asked = wanted.join(query_terms(queries), "query_id").groupBy("term", "segment").agg(F.collect_list("query_id").alias("by"))
    rows = postings.select("term", "segment", "docs").join(asked, ["term", "segment"]).select(F.explode("by").alias("query_id"), "docs").select("query_id", F.explode("docs").alias("p"))
    return rows.groupBy("query_id", F.col("p.doc_id").alias("doc_id")).agg(F.round(F.sum("p.impact"), 6).alias("score"))


def search(queries: DataFrame, postings: DataFrame, k: int = 10, first: int = 16) -> tuple[DataFrame, DataFrame]:
    """The k best documents of each query as BM25 ranks them (ties by doc_id), and the (term, segment) blocks that were read.

    The `first` segments of the greatest bounds are scored; the k-th best score there is a limit that the result can only raise,
    so segments bounded below it hold no document of the result and their blocks are never read.
    """
    bounds = kept(block_bounds(queries, postings))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment")
    ranked = bounds.withColumn("n", F.row_number().over(order))
    early = kept(_scores(queries, postings, ranked.where(F.col("n") <= first).select("query_id", "segment")))
    limit = top_k(early, "score", k).where(F.col("rank") == k).select("query_id", F.col("score").alias("limit"))
    # scores are rounded to six places, so a bound counts up to that
    late = kept(ranked.where(F.col("n") > first).join(limit, "query_id", "left").where(F.col("limit").isNull() | (F.col("bound") + 1e-6 >= F.col("limit"))).select("query_id", "segment"))
    read = ranked.where(F.col("n") <= first).select("query_id", "segment").unionByName(late).join(query_terms(queries), "query_id").select("term", "segment").distinct()
    blocks = postings.select("term", "segment").join(read, ["term", "segment"], "left_semi")
    return top_k(early.unionByName(_scores(queries, postings, late)), "score", k), blocks
