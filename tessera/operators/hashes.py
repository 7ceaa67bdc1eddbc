"""Hash operators: map columns, and long form (key, field, value, expire_ms) where fields can expire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hset(m: Column, field: Column, value: Column) -> Column:
    """The field set; an earlier value goes."""
    kept = F.map_filter(m, lambda k, _: k != field)
    return F.map_concat(kept, F.create_map(field, value))


def hsetnx(m: Column, field: Column, value: Column) -> Column:
    return F.when(F.map_contains_key(m, field), m).otherwise(F.map_concat(m, F.create_map(field, value)))


def hget(m: Column, field: str) -> Column:
    return F.try_element_at(m, F.lit(field))


def hmget(m: Column, fields: list[str]) -> Column:
    return F.array(*[hget(m, f) for f in fields])


def hdel(m: Column, fields: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(fields))


def hincrby(log: DataFrame) -> DataFrame:
    """Sums of a log (key, field, delta)."""
    return log.groupBy("key", "field").agg(F.sum("delta").alias("value"))


def hexpire_status(old: Column, new: Column, gate: str | None = None) -> Column:
    """1 where the field's expiry is set, 0 where the gate holds it; GT and LT pass for fields without one."""
    passes = {
        None: F.lit(True),
        "NX": old.isNull(),
        "XX": old.isNotNull(),
        "GT": old.isNull() | (new > old),
        "LT": old.isNull() | (new < old),
    }[gate]
    return F.when(passes, 1).otherwise(0)


def hexpire(fields: DataFrame, which: Column, at_ms: Column, gate: str | None = None) -> DataFrame:
    ok = which & (hexpire_status(F.col("expire_ms"), at_ms, gate) == 1)
    return fields.withColumn("expire_ms", F.when(ok, at_ms).otherwise(F.col("expire_ms")))


def hsetex(fields: DataFrame, new: DataFrame, only: str | None = None) -> DataFrame:
    """Upsert new (key, field, value, expire_ms); FNX and FXX ask for all fields of a key to be absent or present."""
    if only:
        seen = new.join(fields.select("key", "field", F.lit(1).alias("there")), ["key", "field"], "left")
        there = F.col("there").isNotNull()
        gate = seen.groupBy("key").agg(F.bool_and(there if only == "FXX" else ~there).alias("ok")).where("ok").select("key")
        new = new.join(gate, "key", "left_semi")
    kept = fields.join(new.select("key", "field"), ["key", "field"], "left_anti")
    return kept.unionByName(new)
