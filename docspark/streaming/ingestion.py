"""Ingestion in batches with partial results: a stream's or a run's batches write chunks and one result a page, and a retry takes what failed.

A batch owns its folders, so a batch that is done again overwrites what it left; its results are written last, and chunks are read
only through good results. A killed batch therefore leaves nothing that is seen, and its repeat leaves one copy of each chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docspark.session import kept

#: Makes the chunks of pages: page_id, error (null for a good chunk), and what else a chunk has.
Maker = Callable[[DataFrame], DataFrame]
RESULT = "page_id long, chunks long, errors long, ok boolean"


def write_batch(pages: DataFrame, folder: str, run: int, batch: int, make: Maker, strict: bool = False) -> None:
    """Index one batch of pages (page_id, ...): the chunks of good pages, then a result a page.

    A page with any failed chunk is not good, and none of its chunks is kept. With `strict`, any error in the batch marks no page at
    all. A page without chunks is good.
    """
    made, place = kept(make(pages)), f"run={run}/batch={batch}"
    counts = made.groupBy("page_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("error").alias("errors"))
    results = pages.select("page_id").distinct().join(counts, "page_id", "left").na.fill(0, ["chunks", "errors"])
    failed = strict and made.where("error is not null").limit(1).count() > 0
    results = kept(results.select("page_id", "chunks", "errors", ((F.col("errors") == 0) & ~F.lit(failed)).alias("ok")))
    good = made.where("error is null").join(results.where("ok").select("page_id"), "page_id", "left_semi").drop("error")
    good.write.mode("overwrite").parquet(f"{folder}/chunks/{place}")
    results.write.mode("overwrite").parquet(f"{folder}/results/{place}")


def stream(pages: DataFrame, folder: str, run: int, make: Maker, checkpoint: str, strict: bool = False) -> StreamingQuery:
    """All pages of a stream so far, batch by batch; started again with its checkpoint it goes on with the batch that broke off."""
    sink = pages.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, folder, run, batch, make, strict))
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Every result: page_id, chunks, errors, ok, run, batch; none before the first batch."""
    try:
        return spark.read.schema(f"{RESULT}, run int, batch long").parquet(f"{folder}/results")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{RESULT}, run int, batch long")


def pending(pages: DataFrame, folder: str) -> DataFrame:
    """The pages without a good result: new ones, and those that failed."""
    return pages.join(results(pages.sparkSession, folder).where("ok").select("page_id"), "page_id", "left_anti")


def batch_totals(spark: SparkSession, folder: str) -> DataFrame:
    """run, batch, pages, indexed (chunks of good pages), failed (pages)."""
    indexed = F.sum(F.when(F.col("ok"), F.col("chunks")).otherwise(0))
    return results(spark, folder).groupBy("run", "batch").agg(F.count(F.lit(1)).alias("pages"), indexed.alias("indexed"), F.count_if(~F.col("ok")).alias("failed"))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of every good page, of its newest good result where it has several."""
    newest = Window.partitionBy("page_id").orderBy(F.desc("run"), F.desc("batch"))
    good = results(spark, folder).where("ok").withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("page_id", "run", "batch")
    return spark.read.parquet(f"{folder}/chunks").join(good, ["page_id", "run", "batch"], "left_semi")
