"""A corpus pipeline of four stages over `documents`: language ID, near-duplicates, source mixing, packing.

Every stage works on all documents that the one before kept; its result is written as Parquet and read again. Columns of the
documents keep their names and values, also those with the names of a stage's working columns. An empty table, or one of null
texts alone, leaves nothing after the first stage, and the others return empty results; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import langid, minhash, mixing, packing
from docspark.llm.common import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the bitmask filters find; those with a null text, without letters or a clear language go."""
    return langid.keep_identified(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest doc_id (null ones last); of equal rows one stays."""
    return minhash.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the weighted mix, shard by shard; one taken in both passes over its source stands twice. A null source is a source; texts without words are never taken."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; repeated rows are documents of their own."""
    return packing.packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [("language_id", identified), ("near_duplicates", unlike), ("mixing", mixed), ("packing", packed)]

#: Language ID, links on shingle sets and packing have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
