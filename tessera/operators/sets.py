"""Set algebra over (key, member) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def members(space: DataFrame, key) -> DataFrame:
    return space.where(F.col("key") == key).select("member").distinct()


def sinter(space: DataFrame, keys: list) -> DataFrame:
    """One aggregation for any number of sets: members that all keys hold."""
    some = space.where(F.col("key").isin(keys)).select("key", "member").distinct()
    return some.groupBy("member").agg(F.count("*").alias("n")).where(F.col("n") == len(set(keys))).select("member")


def sunion(space: DataFrame, keys: list) -> DataFrame:
    return space.where(F.col("key").isin(keys)).select("member").distinct()


def sdiff(space: DataFrame, first, rest: list) -> DataFrame:
    """Members of the first set that no other holds, by one aggregation."""
    some = space.where(F.col("key").isin([first, *rest]))
    flag = some.groupBy("member").agg(F.bool_or(F.col("key") == first).alias("a"), F.bool_or(F.col("key").isin(rest)).alias("b"))
    return flag.where("a and not b").select("member")


def sintercard(space: DataFrame, keys: list, limit: int = 0) -> DataFrame:
    n = F.count("*")
    return sinter(space, keys).agg((F.least(n, F.lit(limit)) if limit else n).alias("n"))


def smismember(space: DataFrame, key, wanted: DataFrame) -> DataFrame:
    found = members(space, key).withColumn("hit", F.lit(1))
    return wanted.join(found, "member", "left").select("pos", "member", F.coalesce("hit", F.lit(0)).alias("is_member"))


def srandmember(space: DataFrame, key, n: int, seed: int = 7) -> DataFrame:
    """n members; a negative n draws with replacement."""
    held = members(space, key)
    if n >= 0:
        return held.orderBy(F.xxhash64("member", F.lit(seed)), "member").limit(n)
    # every draw takes the member whose salted hash is the smallest
    draws = F.explode(F.sequence(F.lit(1), F.lit(-n)))
    drawn = held.select("member", draws.alias("draw"))
    return drawn.groupBy("draw").agg(F.min_by("member", F.struct(F.xxhash64("member", "draw", F.lit(seed)), "member")).alias("member"))


def smove(space: DataFrame, source, target, member) -> DataFrame:
    moved = (F.col("key") == source) & (F.col("member") == member)
    return space.withColumn("key", F.when(moved, F.lit(target)).otherwise(F.col("key"))).distinct()
