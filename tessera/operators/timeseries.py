"""Time series over (series, ts in milliseconds, value): duplicates, retention, bucketed aggregation, rules, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.num import bucket

#: Aggregators over (ts, value); those of samples are 0 for a single one.
AGGREGATORS = {
    "avg": lambda: F.avg("value"),
    "sum": lambda: F.sum("value"),
    "min": lambda: F.min("value"),
    "max": lambda: F.max("value"),
    "range": lambda: F.max("value") - F.min("value"),
    "count": lambda: F.count("value").cast("double"),
    "first": lambda: F.min_by("value", "ts"),
    "last": lambda: F.max_by("value", "ts"),
    "std.p": lambda: F.stddev_pop("value"),
    "std.s": lambda: F.coalesce(F.stddev_samp("value"), F.lit(0.0)),
    "var.p": lambda: F.var_pop("value"),
    "var.s": lambda: F.coalesce(F.var_samp("value"), F.lit(0.0)),
}


def deduplicated(samples: DataFrame, policy: str = "last", order: str = "seq") -> DataFrame:
    """One value for each series and ts; samples carry an arrival order."""
    value = {
        "first": F.min_by("value", order),
        "last": F.max_by("value", order),
        "min": F.min("value"),
        "max": F.max("value"),
        "sum": F.sum("value"),
        "block": F.min_by("value", order),
    }[policy]
    return samples.groupBy("series", "ts").agg(value.alias("value"))


def in_order(samples: DataFrame, order: str = "seq") -> DataFrame:
    """Samples that aren't older than any that arrived before them."""
    w = Window.partitionBy("series").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    newest = samples.withColumn("newest__", F.max("ts").over(w))
    return newest.where(F.col("newest__").isNull() | (F.col("ts") >= F.col("newest__"))).drop("newest__")


def retained(samples: DataFrame, retention_ms: int) -> DataFrame:
    """Samples no older than the series' newest less the retention; nothing goes while that isn't above 0.

    The newest sample comes from an aggregation that is combined before its shuffle, not from a window over the series.
    """
    cutoff = samples.groupBy("series").agg((F.max("ts") - retention_ms).alias("cutoff__"))
    joined = samples.join(cutoff, "series")
    return joined.where((F.col("cutoff__") <= 0) | (F.col("ts") >= F.col("cutoff__"))).drop("cutoff__")


def between(samples: DataFrame, start: int, end: int) -> DataFrame:
    return samples.where(F.col("ts").between(start, end))


def aggregated(samples: DataFrame, how: str, size: int, align: int = 0) -> DataFrame:
    """(series, ts, value) by bucket; empty buckets are absent."""
    keyed = samples.withColumn("bucket__", bucket(F.col("ts"), size, align))
    return keyed.groupBy("series", "bucket__").agg(AGGREGATORS[how]().alias("value")).withColumnRenamed("bucket__", "ts")


def ts_range(samples: DataFrame, start: int, end: int, how: str | None = None, size: int = 0, align: int = 0, count: int | None = None, reverse: bool = False) -> DataFrame:
    """A range of each series, aggregated if asked; count limits what comes out, after order and aggregation."""
    out = between(samples, start, end)
    out = aggregated(out, how, size, align) if how else out
    if count is None:
        return out
    order = F.desc("ts") if reverse else F.asc("ts")
    numbered = out.withColumn("i__", F.row_number().over(Window.partitionBy("series").orderBy(order)))
    return numbered.where(F.col("i__") <= count).drop("i__")


def downsampled(samples: DataFrame, how: str, size: int, align: int = 0) -> DataFrame:
    """What a rule has emitted: each series' buckets but its last, which is still open."""
    rows = aggregated(samples, how, size, align)
    last = samples.groupBy("series").agg(bucket(F.max("ts"), size, align).alias("open__"))
    return rows.join(last, "series").where("ts < open__").drop("open__")


def running_total(deltas: DataFrame) -> DataFrame:
    w = Window.partitionBy("series").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("value", F.sum("value").over(w))


def last_samples(samples: DataFrame) -> DataFrame:
    return samples.groupBy("series").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))


def info(samples: DataFrame) -> DataFrame:
    return samples.groupBy("series").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def deleted(samples: DataFrame, start: int, end: int) -> DataFrame:
    return samples.where(~F.col("ts").between(start, end))


def label_filter(labels: Column, expression: str) -> Column:
    """l=v, l!=v, l=(a,b), l!=(a,b); l= means absent and l!= present."""
    negative = "!=" in expression
    name, _, wanted = expression.partition("!=" if negative else "=")
    found = F.try_element_at(labels, F.lit(name))
    if not wanted:
        return found.isNotNull() if negative else found.isNull()
    values = [x.strip() for x in wanted.strip("()").split(",")]
    inside = F.coalesce(found.isin(values), F.lit(False))
    return ~inside if negative else inside


def query_index(series: DataFrame, filters: list[str]) -> DataFrame:
    ok = F.lit(True)
    for f in filters:
        ok = ok & label_filter(F.col("labels"), f)
    return series.where(ok)
