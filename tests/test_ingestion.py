from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docspark.session import with_checkpoints
from docspark.sources import logs
from docspark.streaming import ingestion, stateful


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    """Three files of pages, so three batches of a stream that takes a file a batch."""
    with_checkpoints(spark)
    folder = str(tmp_path_factory.mktemp("pages"))
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select(F.col("id").alias("page_id")).coalesce(1).write.mode("append").parquet(folder)
    return folder


def three_chunks(bad: list[int]):
    def make(rows):
        each = rows.where("page_id <> 5").select("page_id", F.explode(F.array(*map(F.lit, range(3)))).alias("n"))
        return each.select("page_id", "n", F.when(F.col("page_id").isin(bad) & (F.col("n") == 1), "broken").alias("error"))

    return make


def source(spark, pages):
    return spark.readStream.schema("page_id long").option("maxFilesPerTrigger", 1).parquet(pages)


def test_killed_batch_is_done_again_and_retry_takes_failed_pages_alone(spark, pages, tmp_path, monkeypatch):
    folder, checkpoint = str(tmp_path / "index"), str(tmp_path / "checkpoint")
    whole, calls = ingestion.kept, []

    def dies_once(rows):
        calls.append(1)
        if len(calls) == 4:  # the second batch has made its chunks, and dies before its results
            raise RuntimeError("killed")
        return whole(rows)

    monkeypatch.setattr(ingestion, "kept", dies_once)
    with pytest.raises(Exception, match="killed"):
        ingestion.stream(source(spark, pages), folder, 1, three_chunks([3, 17]), checkpoint).awaitTermination()
    assert ingestion.results(spark, folder).select("batch").distinct().count() == 1
    ingestion.stream(source(spark, pages), folder, 1, three_chunks([3, 17]), checkpoint).awaitTermination()
    assert {r.page_id for r in ingestion.results(spark, folder).where("not ok").collect()} == {3, 17}
    every = spark.read.parquet(pages)
    waiting = ingestion.pending(every, folder)
    assert {r.page_id for r in waiting.collect()} == {3, 17}
    ingestion.write_batch(waiting, folder, 2, 0, three_chunks([17]))
    ingestion.write_batch(ingestion.pending(every, folder), folder, 3, 0, three_chunks([]))
    ingestion.write_batch(waiting, folder, 3, 0, three_chunks([]))  # the same batch again
    assert ingestion.pending(every, folder).count() == 0
    found = ingestion.chunks(spark, folder)
    assert found.count() == found.select("page_id", "n").distinct().count() == 29 * 3
    totals = {(r.run, r.pages, r.failed) for r in ingestion.batch_totals(spark, folder).collect()}
    assert (2, 2, 1) in totals and (1, 10, 1) in totals


def test_strict_batches_mark_nothing_after_an_error(spark, pages, tmp_path):
    folder, every = str(tmp_path / "index"), spark.read.parquet(pages)
    assert ingestion.pending(every, folder).count() == 30
    ingestion.write_batch(every.where("page_id < 10"), folder, 1, 0, three_chunks([4]), strict=True)
    ingestion.write_batch(every.where("page_id >= 10"), folder, 1, 1, three_chunks([4]), strict=True)
    assert {r.page_id for r in ingestion.pending(every, folder).collect()} == set(range(10))
    assert ingestion.chunks(spark, folder).count() == 60


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    folder, at = tmp_path / "events", dt.datetime(2024, 1, 1)
    folder.mkdir()

    def add(name: str, seconds: list[int]) -> None:
        rows = [f'{{"ts": "{(at + dt.timedelta(seconds=s)).isoformat()}", "event_type": "error"}}\n' for s in seconds]
        (folder / f"{name}.json").write_text("".join(rows))

    events = spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).json(str(folder))
    query = stateful.windowed_errors(events, "10 seconds", "10 seconds", late="20 seconds").writeStream.format("memory").queryName("late_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    for name, seconds in (("a", [1, 2, 100]), ("b", [3, 101]), ("c", [4, 95, 200]), ("d", [300])):
        add(name, seconds)
        query.processAllAvailable()
    late = stateful.dropped_late(query.recentProgress)
    query.stop()
    rows = {int((r.window.start - at).total_seconds()): r.errors for r in spark.table("late_rows").collect()}
    assert late == 2  # 3 and 4 came behind a watermark of 80 seconds
    assert rows == {0: 2, 90: 1, 100: 2, 200: 1}


def test_growing_logs_resume_without_loss_or_repeats(spark, tmp_path, monkeypatch):
    logs.register(spark)
    folder, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "c")
    folder.mkdir()

    def run() -> list[tuple[str, str]]:
        rows = spark.readStream.format("log_tail").option("path", str(folder)).load()
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.file.rsplit("/", 1)[-1], r.line) for r in spark.read.parquet(out).collect())

    a, b = folder / "a.log", folder / "b.log"
    a.write_text("one\ntwo\nthr")
    (folder / "other.txt").write_text("not a log\n")
    assert run() == [("a.log", "one"), ("a.log", "two")]
    with a.open("a") as f:
        f.write("ee\nfour\r\n")
    b.write_text("é\n" * 3 + "open end")
    assert run() == [("a.log", x) for x in ("four", "one", "three", "two")] + [("b.log", "é")] * 3
    assert run() == run()


def test_log_ranges_split_at_line_ends(tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "RANGE_BYTES", 7)
    lines = ["x" * n for n in (0, 1, 30, 6, 7, 2, 0, 13)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    reader = logs._Tail(str(tmp_path), ".log")
    got = [line for part in reader.partitions({}, reader.latestOffset()) for _, _, line in reader.read(part)]
    assert got == lines
