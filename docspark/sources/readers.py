"""Sources: golden cases, run files, repositories, JSON logs; and state tables written as versioned snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "case_id string, url string, question string, expected_output string, expected_retrieval_context array<string>"
RUN = "run_id string, timestamp string, commit string, cases array<struct<case_id: string, question: string, status: string, expected_output: string, actual_output: string, retrieval_context: array<string>, scores: map<string,double>, error: string>>"
REQUIRED = ("case_id", "url", "question", "expected_output")


def golden_cases(spark: SparkSession, cases: Sequence[Mapping[str, object]]) -> DataFrame:
    """Strict: no cases, a missing key or an unknown one is an error."""
    known = [c.split(" ")[0] for c in CASE.split(", ")]
    if not cases:
        raise ValueError("no cases")
    for i, case in enumerate(cases):
        if missing := [k for k in REQUIRED if k not in case]:
            raise ValueError(f"case {i}: missing {', '.join(missing)}")
        if extra := sorted(set(case) - set(known)):
            raise ValueError(f"case {i}: unknown {', '.join(extra)}")
    return spark.createDataFrame([tuple(c.get(k) for k in known) for c in cases], CASE)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run files with name and time; documents that can't be read are left out."""
    rows = spark.read.schema(RUN + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(folder)
    return rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified")).where("_bad is null and run_id is not null").drop("_bad")


def newest_run(spark: SparkSession, folder: str, exclude: str | None = None) -> DataFrame:
    found = runs(spark, folder)
    return (found.where(F.col("file") != exclude) if exclude else found).orderBy(F.desc("file")).limit(1)


def newest_runs(spark: SparkSession, folder: str, most: int = 2) -> DataFrame:
    """The latest runs by their own time, then by file; the first is the current one."""
    return runs(spark, folder).orderBy(F.desc_nulls_last("timestamp"), F.desc("file")).limit(most)


def run_summary(run: DataFrame) -> DataFrame:
    """run_id, timestamp, commit, case_count, avg_scores: a metric's sum over the scored cases by the number of all scored ones."""
    keys = ["run_id", "timestamp", "commit"]
    scored = F.filter("cases", lambda c: c["status"] == "scored")
    sized = run.select(*keys, F.size("cases").alias("case_count"), F.greatest(F.size(scored), F.lit(1)).alias("n"), scored.alias("scored"))
    marks = sized.select(*keys, "case_count", "n", F.explode_outer("scored").alias("c")).select(*keys, "case_count", "n", F.explode_outer("c.scores").alias("metric", "score"))
    means = marks.groupBy(*keys, "case_count", "n", "metric").agg((F.sum("score") / F.col("n")).alias("mean"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("metric").isNotNull(), F.struct("metric", "mean"))))  # one a metric
    return means.groupBy(*keys, "case_count").agg(F.map_from_entries(pairs).alias("avg_scores"))


#: Summaries stand beside the runs in a folder whose name readers of the runs pass over.
SUMMARIES = "_summaries"
SUMMARY = "run_id string, timestamp string, commit string, case_count int, avg_scores map<string,double>"


def write_run(run: DataFrame, folder: str) -> None:
    """Append runs, and a summary of each for quick listing."""
    run.write.mode("append").json(folder)
    run_summary(run).write.mode("append").json(f"{folder}/{SUMMARIES}")


def run_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """All summaries, newest first."""
    return spark.read.schema(SUMMARY).json(f"{folder}/{SUMMARIES}").orderBy(F.desc_nulls_last("timestamp"), F.desc("run_id"))


def repository(spark: SparkSession, folder: str, most_bytes: int = 250_000) -> DataFrame:
    """Text files under a folder: path, size, text. Files with NUL bytes, invalid UTF-8, or outside the size window are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where((F.col("length") > 0) & (F.col("length") <= most_bytes))
    plain = files.where(F.is_valid_utf8(F.col("content").cast("string")) & ~F.contains(F.substring(F.col("content"), 1, 4096), F.lit(bytearray(b"\0"))))
    return plain.select("path", F.col("length").alias("size"), F.col("content").cast("string").alias("text"))


def json_lines(spark: SparkSession, folder: str, schema: str, stream: bool = False) -> DataFrame:
    """Newline-delimited JSON, batch or stream; malformed lines are dropped."""
    text = (spark.readStream if stream else spark.read).format("text").load(folder)
    return text.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "value").where(F.col("r").isNotNull() & F.col("value").rlike(r"^\s*\{.*\}\s*$")).select("r.*")


COMMITS = "version long, tables array<string>"


def commit(spark: SparkSession, folder: str, version: int, tables: Sequence[str] = ()) -> None:
    """The last step of a version: a record of its own file, which makes it one that readers see."""
    spark.createDataFrame([(version, list(tables))], COMMITS).coalesce(1).write.mode("append").json(f"{folder}/commits")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The complete versions under a folder, oldest first. A torn record is no commit; a folder without any has no versions."""
    try:
        rows = spark.read.schema(COMMITS).json(f"{folder}/commits").where("version is not null").distinct().collect()  # a row a version
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted({r.version for r in rows})


def write_snapshot(table: DataFrame, folder: str, version: int) -> str:
    """A new version beside the old ones; never overwrites what a reader may have open. Readers take the newest complete one."""
    path = f"{folder}/v={version}"
    table.write.mode("errorifexists").parquet(path)
    commit(table.sparkSession, folder, version)
    return path


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the newest version that is complete and whose files can be read; none is an error."""
    for version in reversed(versions(spark, folder)):
        try:
            return spark.read.parquet(f"{folder}/v={version}")
        except (PySparkException, Py4JError):  # gone or torn: the one before it
            continue
    raise FileNotFoundError(f"no complete version in {folder}")


def write_version(tables: Mapping[str, DataFrame], folder: str, version: int) -> bool:
    """Several tables as one version, each under its name. A complete version is left as it is (False); one that broke off is written anew."""
    spark = next(iter(tables.values())).sparkSession
    if version in versions(spark, folder):
        return False
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/v={version}/{name}")
    commit(spark, folder, version, list(tables))
    return True


def read_version(spark: SparkSession, folder: str, version: int, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/v={version}/{name}") for name in names}


def append_log(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").parquet(folder)
