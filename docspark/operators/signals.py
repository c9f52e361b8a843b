"""Evaluation scores, labelled metrics, alerts and log lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the request latency histogram, in seconds.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
REGRESSION = 0.05


def long_scores(cases: DataFrame) -> DataFrame:
    """cases(run_id, case_id, status, scores map) -> one row a score."""
    return cases.select("run_id", "case_id", "status", F.explode("scores").alias("metric", "score"))


def mean_present(cases: DataFrame) -> DataFrame:
    """Mean of a metric over the scored cases that have it."""
    rows = long_scores(cases.where("status = 'scored'")).where("score is not null")
    return rows.groupBy("run_id", "metric").agg(F.round(F.avg("score"), 9).alias("mean"))


def mean_all(cases: DataFrame) -> DataFrame:
    """Sum of a metric over all scored cases of the run: a missing score counts 0."""
    n = cases.where("status = 'scored'").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    sums = long_scores(cases.where("status = 'scored'")).groupBy("run_id", "metric").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("total"))
    return sums.join(n, "run_id").select("run_id", "metric", F.round(F.col("total") / F.greatest("n", F.lit(1)), 9).alias("mean"))


def compare(baseline: DataFrame, current: DataFrame, threshold: float = REGRESSION) -> DataFrame:
    """metric, baseline, current, delta, regressed: metrics of one side only are kept with a null delta and never regress."""
    both = baseline.select("metric", F.col("mean").alias("baseline")).join(current.select("metric", F.col("mean").alias("current")), "metric", "full_outer")
    delta = F.round(F.col("current") - F.col("baseline"), 9)
    return both.withColumn("delta", delta).withColumn("regressed", F.coalesce(F.col("delta") < -threshold, F.lit(False)))


def counters(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("total"))


def histogram(rows: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative buckets (values at a bound are in it), then +Inf, with sum and count. One aggregation, then the bounds unfold."""
    within = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    agg = rows.groupBy(*labels).agg(*within, F.count(value).alias("count"), F.round(F.sum(value), 6).alias("sum"))
    buckets = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n")))
    return agg.select(*labels, "count", "sum", F.explode(buckets).alias("b")).select(*labels, "b.le", F.col("b.n").alias("n"), "count", "sum")


def last_value(rows: DataFrame, labels: Sequence[str], value: str, at: str) -> DataFrame:
    return rows.groupBy(*labels).agg(F.max_by(value, at).alias("value"))


def increase_alerts(rows: DataFrame, is_error: Column, window: str = "1 minute", every: str = "15 seconds", above: int = 0) -> DataFrame:
    """Sliding windows with more than `above` errors."""
    return rows.where(is_error).groupBy(F.window("ts", window, every)).agg(F.count(F.lit(1)).alias("errors")).where(F.col("errors") > above).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "errors")


def change_alerts(rows: DataFrame, key: str, value: str, at: str, minutes: int = 5) -> DataFrame:
    """Windows in which a series changed its value, with how often."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(at, "event_id"))
    return rows.withColumn("changed", (before != F.col(value)).cast("int")).groupBy(key, F.window(at, f"{minutes} minutes")).agg(F.sum("changed").alias("changes")).where("changes > 0").select(key, F.col("window.start").alias("start"), "changes")


def error_class(status: Column) -> Column:
    return F.when(status >= 500, "critical").when(status >= 400, "warning").otherwise("ok")


#: Dotted metric names, the series they go to, and its labels ($1, $2, ... are the parts at the stars).
STATSD = (
    ("airflow.dagrun.duration.success.*", "airflow_dagrun_duration_seconds", {"status": "success", "dag_id": "$1"}),
    ("airflow.dagrun.duration.failed.*", "airflow_dagrun_duration_seconds", {"status": "failed", "dag_id": "$1"}),
    ("airflow.dagrun.success.*", "airflow_dagrun_total", {"status": "success", "dag_id": "$1"}),
    ("airflow.dagrun.failed.*", "airflow_dagrun_total", {"status": "failed", "dag_id": "$1"}),
    ("airflow.ti.duration.*.*.*", "airflow_task_duration_seconds", {"dag_id": "$1", "task_id": "$2", "status": "$3"}),
    ("airflow.ti_successes", "airflow_task_instance_total", {"status": "success"}),
    ("airflow.ti_failures", "airflow_task_instance_total", {"status": "failed"}),
)


def statsd_pattern(match: str) -> str:
    return "^" + match.replace(".", r"\.").replace("*", "([^.]*)") + "$"


def statsd(name: Column) -> Column:
    """struct<series, dag_id, task_id, status> of the first rule that fits, else null."""
    out: Column | None = None
    for match, series, labels in STATSD:
        pattern = statsd_pattern(match)
        get = lambda k: (F.regexp_extract(name, pattern, int(v[1:])) if (v := labels[k]).startswith("$") else F.lit(v)) if k in labels else F.lit(None).cast("string")  # noqa: E731, B023
        value = F.struct(F.lit(series).alias("series"), *[get(k).alias(k) for k in ("dag_id", "task_id", "status")])
        out = F.when(name.rlike(pattern), value) if out is None else out.when(name.rlike(pattern), value)
    assert out is not None
    return out


LOG_LINE = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d+) - ([^ ]+) - (INFO|WARNING|ERROR|DEBUG|CRITICAL)"


def log_fields(line: Column) -> Column:
    return F.struct(F.regexp_extract(line, LOG_LINE, 1).alias("time"), F.regexp_extract(line, LOG_LINE, 2).alias("logger"), F.regexp_extract(line, "(INFO|WARNING|ERROR|DEBUG|CRITICAL)", 1).alias("level"))


def exposition(series: DataFrame, name: str, labels: Sequence[str]) -> DataFrame:
    """Text lines `name{label="value",...} total`."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{x}="'), F.col(x).cast("string"), F.lit('"')) for x in labels])
    return series.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col("total").cast("string")).alias("line"))
