"""Streaming forms: projections, downsampling, deduplication, fan-out, rate limits and consumer groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def project(events: DataFrame, by: str, value: str) -> DataFrame:
    """A maintained view: count, sum, max and latest by key; for update or complete output."""
    return events.groupBy(by).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("highest"), F.max_by(value, "ts").alias("latest")
    )


def downsample(samples: DataFrame, size: str, lateness: str) -> DataFrame:
    """Closed buckets of each series, for append output; samples later than the lateness are left out."""
    return (
        samples.withWatermark("ts", lateness)
        .groupBy("series", F.window("ts", size))
        .agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
        .select("series", F.col("window.start").alias("ts"), "mean", "low", "high", "n")
    )


def deduplicate(events: DataFrame, window: str) -> DataFrame:
    """Each (bucket, id) once within a window of event time."""
    return events.withWatermark("ts", window).dropDuplicatesWithinWatermark(["bucket", "id"])


def pair_spans(starts: DataFrame, ends: DataFrame, longest: str) -> DataFrame:
    """Spans whose end follows their start within a time, by a stream-stream join."""
    a = starts.withWatermark("start_ts", longest).alias("a")
    b = ends.withWatermark("end_ts", longest).alias("b")
    close = F.expr(f"a.span = b.span and b.end_ts >= a.start_ts and b.end_ts <= a.start_ts + interval {longest}")
    return a.join(b, close).select("a.span", "a.start_ts", "b.end_ts")


def fan_out(events: DataFrame, routes: dict[str, Callable[[DataFrame], None]]):
    """A writer that hands each micro-batch to the sinks of the globs that its channel fits."""
    from tessera.operators.keyspace import glob_regex

    def each(batch: DataFrame, _: int) -> None:
        for pattern, sink in routes.items():
            sink(batch.where(F.col("channel").rlike(glob_regex(pattern))))

    return events.writeStream.foreachBatch(each)


def rate_limited(calls: DataFrame, period_ms: int, most: int) -> DataFrame:
    """calls (key, seq, ts_ms) with allowed; the theoretical arrival time is a key's state and ends after a period."""
    interval = period_ms / most

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tat = state.get[0] if state.exists else 0.0
        for frame in frames:
            frame = frame.sort_values(["ts_ms", "seq"])
            allowed = []
            for now in frame["ts_ms"]:
                new = max(tat, now) + interval
                ok = new - period_ms <= now
                tat = new if ok else tat
                allowed.append(ok)
            yield pd.DataFrame({"key": key[0], "seq": frame["seq"], "allowed": allowed})
        state.update((float(tat),))
        state.setTimeoutDuration(max(1, period_ms))

    return calls.groupBy("key").applyInPandasWithState(
        step, "key long, seq long, allowed boolean", "tat double", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def consumer_group(log: DataFrame) -> DataFrame:
    """Pending entries by consumer after each micro-batch of a delivery log (grp, op: deliver or ack, consumer, id).

    A group's state holds its pending ids with their consumers; an ack removes its id, a later delivery moves it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        for frame in frames:
            for op, consumer, entry in zip(frame["op"], frame["consumer"], frame["id"], strict=True):
                if op == "deliver":
                    held[entry] = consumer
                else:
                    held.pop(entry, None)
        state.update((list(held), list(held.values())))
        counts = pd.Series(list(held.values()), dtype="object").value_counts()
        yield pd.DataFrame({"grp": key[0], "consumer": counts.index.astype(str), "pending": counts.to_numpy()})

    return log.groupBy("grp").applyInPandasWithState(
        step, "grp string, consumer string, pending long", "ids array<long>, consumers array<string>", "update", GroupStateTimeout.NoTimeout
    )
