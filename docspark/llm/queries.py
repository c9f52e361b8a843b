"""The queries of the corpus operators, by name, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import ann, bloomlm, chat, langid, merkle, minhash, mixing, packing, pieces, resample, simhash, tokenfiles, warc
from docspark.llm.common import materialize, table


def op1_rotated_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(chat.as_tool_messages(table(spark, sf_dir, "conversations")), chat.TOOLS)


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op5_minhash_bbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report_with_links(table(spark, sf_dir, "documents"), lambda report: materialize(report, "simhash-report"))


def op7_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"))


def op8_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloomlm.scores(table(spark, sf_dir, "documents"))


def op9_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).drop("first_shard")


def op10_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


def op11_radix_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sentencepiece_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = pieces.model_path()
    return pieces.digests(pieces.decoded(pieces.encoded(table(spark, sf_dir, "documents"), path), path))


def op13_merkle_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op1_rotated_bit_codes": ann.ORACLE, "op2_tool_call_linking": chat.ORACLE, "op3_warc_index": warc.ORACLE, "op9_mixing_tree": mixing.ORACLE,
            "op11_radix_resampling": resample.ORACLE, "op13_merkle_versions": merkle.ORACLE}
