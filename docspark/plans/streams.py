"""Queries of the stateful operators, as batch replays; sequential state has no SQL, so tests compare them with loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.session import table
from docspark.streaming import stateful as X


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("at", F.expr("unix_micros(cast(ts as timestamp))") / F.lit(1e6))


def ttl_cache_replay(spark: SparkSession, d: str) -> DataFrame:
    return X.replay(_timed(spark, d), "user_id", ["at", "event_id"], ["at"], X.ttl_step, (None,), "status string").select("event_id", "status")


def rate_limit_replay(spark: SparkSession, d: str) -> DataFrame:
    """One request an hour with a burst of two."""
    return X.replay(_timed(spark, d), "user_id", ["at", "event_id"], ["at"], X.leaky_step(1 / 3600, 2.0), (0.0, None), "status string").select("event_id", "status")


def task_machine_replay(spark: SparkSession, d: str) -> DataFrame:
    return X.replay(_timed(spark, d), "user_id", ["at", "event_id"], ["at", "event_type"], X.task_step, (None, None, None, None), "phase string, seq long").select("event_id", "phase", "seq")


def sliding_errors(spark: SparkSession, d: str) -> DataFrame:
    return X.windowed_errors(table(spark, d, "events")).select(F.to_timestamp_ntz(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss")).alias("start"), "errors")


SQL = {"sliding_errors": "WITH e AS (SELECT time_bucket(INTERVAL 15 SECONDS, ts) AS b FROM events WHERE event_type = 'error'), w AS (SELECT b - to_seconds(15 * i) AS start FROM e, range(4) r(i)) SELECT start, count(*) AS errors FROM w GROUP BY start"}
QUERIES = {f.__name__: f for f in (ttl_cache_replay, rate_limit_replay, task_machine_replay, sliding_errors)}
