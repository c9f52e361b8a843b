"""Stateful operators over event streams: sliding alerts, TTL caches, rate limits, task machines, idempotency.

Each works on a batch or a streaming frame where Spark allows both; sequential state is kept by key with
applyInPandasWithState, whose batch counterpart replays a key's events in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "168 hours"
TTL_SECONDS = 3600
INACTIVE_SECONDS = 1800


def windowed_errors(events: DataFrame, window: str = "1 minute", every: str = "15 seconds", late: str = LATE) -> DataFrame:
    """Errors by sliding window; in a stream, events later than `late` are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).where("event_type = 'error'")
    return rows.groupBy(F.window("ts", window, every)).agg(F.count(F.lit(1)).alias("errors"))


def first_by_key(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """The first event of each idempotency key; repeats inside the watermark are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


Step = Callable[[tuple, tuple], tuple[tuple, tuple]]


def ttl_step(state: tuple, event: tuple) -> tuple[tuple, tuple]:
    """A source cache: the first event of a span of TTL_SECONDS is a miss and starts it, the others are hits."""
    (started,), (at,) = state, event
    if started is None or at - started >= TTL_SECONDS:
        return (at,), ("miss",)
    return state, ("hit",)


def leaky_step(rate: float, burst: float) -> Step:
    """A leaky bucket: `rate` requests a second drain, up to `burst` above that wait, others are refused (429)."""

    def step(state: tuple, event: tuple) -> tuple[tuple, tuple]:
        (excess, last), (at,) = state, event
        now = 0.0 if last is None else max(0.0, excess - (at - last) * rate) + 1.0
        if now > burst:
            return state, ("429",)
        return (now, at), ("200",)

    return step


#: Phases of a task: action -> (phases it may start from, phase it leads to). Terminal phases absorb everything.
MOVES = {"signup": (("new",), "started"), "view": (("started", "working"), "working"), "click": (("working",), "review"), "error": (("working", "review"), "retry"), "purchase": (("review", "working"), "done")}
TERMINAL = ("done", "failed", "expired")
RETRIES = 2


def task_step(state: tuple, event: tuple) -> tuple[tuple, tuple]:
    """A task: (phase, sequence, retries, last time) moved by (time, action); it expires after INACTIVE_SECONDS without one."""
    (phase, seq, retries, last), (at, action) = state, event
    phase = phase or "new"
    seq, retries = seq or 0, retries or 0
    if phase not in TERMINAL and last is not None and at - last > INACTIVE_SECONDS:
        phase = "expired"
    if phase in TERMINAL:
        return (phase, seq, retries, at), (phase, seq)
    start, to = MOVES.get(action, ((), phase))
    if phase in start:
        if to == "retry":
            retries += 1
            to = "failed" if retries > RETRIES else "working"
        phase = to
    return (phase, seq + 1, retries, at), (phase, seq + 1)


def replay(events: DataFrame, key: str, order: list[str], fields: list[str], step: Step, empty: tuple, out: str) -> DataFrame:
    """Batch form: every key's events in order through `step`. out: the schema of what a step says, after key and order.

    Events stream through a partition sorted by key, so a key is never held as a whole.
    """
    names = [key, *order]
    shape = events.select(*names).schema.simpleString()[len("struct<") : -1]
    said = [c.split(" ")[0].split(":")[0] for c in out.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, empty
        for frame in frames:
            rows = []
            for own, event in zip(frame[names].itertuples(index=False, name=None), frame[fields].itertuples(index=False, name=None), strict=True):
                if own[0] != last:
                    last, state = own[0], empty
                state, answer = step(state, event)
                rows.append((*own, *answer))
            yield pd.DataFrame(rows, columns=[*names, *said])

    rows = events.select(*dict.fromkeys([*names, *fields])).repartition(key).sortWithinPartitions(key, *order)
    return rows.mapInPandas(run, f"{shape}, {out}")


def streaming(events: DataFrame, key: str, order: list[str], fields: list[str], step: Step, empty: tuple, out: str, state: str) -> DataFrame:
    """Streaming form of replay(): the state of each key is kept between micro-batches."""
    names = [key, *order]
    shape = events.select(*names).schema.simpleString()[len("struct<") : -1]
    said = [c.split(" ")[0].split(":")[0] for c in out.split(", ")]

    def run(_: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        now = kept.get if kept.exists else empty
        frame = pd.concat(list(frames)).sort_values(order)
        rows = []
        for own, event in zip(frame[names].itertuples(index=False, name=None), frame[fields].itertuples(index=False, name=None), strict=True):
            now, answer = step(tuple(now), event)
            rows.append((*own, *answer))
        kept.update(now)
        yield pd.DataFrame(rows, columns=[*names, *said])

    return events.groupBy(key).applyInPandasWithState(run, f"{shape}, {out}", state, "append", GroupStateTimeout.NoTimeout)


def dropped_late(progress: list) -> int:
    """Rows that a stream's watermark has dropped, from all its progress reports."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
