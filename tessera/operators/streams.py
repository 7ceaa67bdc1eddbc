"""Event logs with (stream, ms, seq) ids, consumer groups from delivery logs, and projections of JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ID = ("ms", "seq")


def with_ids(events: DataFrame, order: str) -> DataFrame:
    """events (stream, ms, …) with seq from 0 among those of one millisecond."""
    return events.withColumn("seq", (F.row_number().over(Window.partitionBy("stream", "ms").orderBy(order)) - 1).cast("long"))


def xrange(log: DataFrame, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """Ids in an inclusive range; the millisecond test alone can reach the scan."""
    entry = F.struct(*ID)
    bound = lambda x: F.struct(F.lit(x[0]).cast("long").alias("ms"), F.lit(x[1]).cast("long").alias("seq"))
    return log.where(F.col("ms").between(start[0], end[0])).where((entry >= bound(start)) & (entry <= bound(end)))


def xtrim(log: DataFrame, maxlen: int) -> DataFrame:
    """The newest entries of each stream."""
    newest = F.row_number().over(Window.partitionBy("stream").orderBy(*[F.desc(c) for c in ID]))
    return log.withColumn("i__", newest).where(F.col("i__") <= maxlen).drop("i__")


def xread(log: DataFrame, after: DataFrame, count: int) -> DataFrame:
    """The next entries of each stream after an id (stream, after_ms, after_seq)."""
    later = log.join(after, "stream").where("ms > after_ms or (ms = after_ms and seq > after_seq)").drop("after_ms", "after_seq")
    return later.withColumn("i__", F.row_number().over(Window.partitionBy("stream").orderBy(*ID))).where(F.col("i__") <= count).drop("i__")


def pending(deliveries: DataFrame, acks: DataFrame) -> DataFrame:
    """Entries of a group that are delivered and not acknowledged: last consumer and time, and how often delivered."""
    last = deliveries.groupBy("grp", "stream", *ID).agg(
        F.max_by("consumer", "delivered_at").alias("consumer"), F.max("delivered_at").alias("delivered_at"), F.count("*").alias("deliveries")
    )
    return last.join(acks, ["grp", "stream", *ID], "left_anti")


def pending_summary(held: DataFrame) -> DataFrame:
    return held.groupBy("grp", "consumer").agg(F.count("*").alias("n"), F.min(F.struct(*ID)).alias("lo"), F.max(F.struct(*ID)).alias("hi"))


def autoclaim(held: DataFrame, log: DataFrame, now, min_idle_ms: int, consumer: str, count: int) -> DataFrame:
    """The oldest idle pending entries that still exist, moved to a consumer."""
    idle = held.where(now - F.col("delivered_at") >= min_idle_ms).join(log, ["stream", *ID], "left_semi")
    picked = idle.withColumn("i__", F.row_number().over(Window.partitionBy("grp", "stream").orderBy(*ID)))
    return picked.where(F.col("i__") <= count).drop("i__").withColumn("consumer", F.lit(consumer)).withColumn("delivered_at", now).withColumn("deliveries", F.col("deliveries") + 1)


def project(log: DataFrame, reducer: str, field: str | None = None, group: str | None = None) -> DataFrame:
    """(stream, grp, value): count, sum, max or latest of a payload field by another; without a group, _total."""
    at = lambda name: F.get_json_object("payload", f"$.{name}")
    grp = F.coalesce(at(group), F.lit("_total")) if group else F.lit("_total")
    number = at(field).try_cast("double") if field else None
    value = {
        "count": lambda: F.count("*").cast("double"),
        "sum": lambda: F.sum(number),
        "max": lambda: F.max(number),
        "latest": lambda: F.max_by(number, "seq"),
    }[reducer]()
    return log.groupBy("stream", grp.alias("grp")).agg(value.alias("value"))


def xdel(log: DataFrame, gone: DataFrame) -> DataFrame:
    """log without the entries of gone (stream, ms, seq)."""
    return log.join(gone.select("stream", *ID).distinct(), ["stream", *ID], "left_anti")


def xtrim_before(log: DataFrame, ms: int, seq: int = 0) -> DataFrame:
    """Entries from an id on, in every stream."""
    return log.where((F.col("ms") > ms) | ((F.col("ms") == ms) & (F.col("seq") >= seq)))
