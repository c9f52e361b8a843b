"""Ingestion of `pages` in batches, where some pages fail in the first run and a second one takes those alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import chunks, embed
from docspark.plans.fulltext import _plain
from docspark.session import shared_folder, table
from docspark.streaming import ingestion

BATCHES = 4


def _make(failing: bool) -> ingestion.Maker:
    """Word chunks with offline vectors; where `failing`, the first chunk of every seventh page has an error."""

    def make(pages: DataFrame) -> DataFrame:
        texts = pages.select("page_id", T.html_to_text("html").alias("text"))
        own = chunks.word_chunks(texts, "page_id", size=120, overlap=20).withColumn("chunk_id", F.concat_ws(":", "page_id", "chunk_index"))
        both = embed.with_vectors(own, embed.embedded(own, "chunk_id"), "chunk_id")
        wrong = (F.col("page_id") % 7 == 3) & (F.col("chunk_index") == 0) & F.lit(failing)
        return both.select("page_id", "chunk_id", "chunk_index", "text", "vector", F.when(wrong | F.col("vector").isNull(), "not embedded").alias("error"))

    return make


def _two_runs(spark: SparkSession, d: str) -> str:
    folder, pages = shared_folder(spark, "ingestion"), table(spark, d, "pages").select("page_id", "html")
    for run, failing in ((1, True), (2, False)):
        waiting = ingestion.pending(pages, folder)
        for batch in range(BATCHES):
            ingestion.write_batch(waiting.where(F.col("page_id") % BATCHES == batch), folder, run, batch, _make(failing))
    return folder


def ingest_totals(spark: SparkSession, d: str) -> DataFrame:
    """Pages, indexed chunks and failed pages of both runs' batches."""
    return ingestion.batch_totals(spark, _two_runs(spark, d))


def ingest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every page's chunks in the end, and the run that they come from."""
    return ingestion.chunks(spark, _two_runs(spark, d)).groupBy("page_id", "run").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("chunk_id").alias("ids"))


_N = f"""w AS (SELECT page_id, len(regexp_extract_all({_plain("html")}, '\\S+')) AS n FROM pages),
c AS (SELECT page_id, CASE WHEN n = 0 THEN 0 WHEN n <= 120 THEN 1 ELSE 1 + ceil((n - 120) / 100)::BIGINT END AS n, page_id % 7 = 3 AND n > 0 AS bad FROM w)"""
SQL = {
    "ingest_totals": f"""WITH {_N} SELECT 1 AS run, page_id % 4 AS batch, count(*) AS pages, sum(CASE WHEN bad THEN 0 ELSE n END)::BIGINT AS indexed, count_if(bad)::BIGINT AS failed FROM c GROUP BY ALL
UNION ALL SELECT 2, page_id % 4, count(*), sum(n)::BIGINT, 0 FROM c WHERE bad GROUP BY ALL""",
    "ingest_chunks": f"WITH {_N} SELECT page_id, CASE WHEN bad THEN 2 ELSE 1 END AS run, n AS chunks, n AS ids FROM c WHERE n > 0",
}
QUERIES = {name: globals()[name] for name in SQL}
