"""Ranked sets over (key, member, score): ranks, ranges, pops and weighted algebra, ordered by (score, member)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY_SCORE = ("score", "member")


def zadd(log: DataFrame) -> DataFrame:
    """Last score of each member in a log (seq, key, member, score)."""
    return log.groupBy("key", "member").agg(F.max_by("score", "seq").alias("score"))


def zincrby(log: DataFrame) -> DataFrame:
    return log.groupBy("key", "member").agg(F.sum("score").alias("score"))


def zrank(zset: DataFrame, reverse: bool = False) -> DataFrame:
    order = [F.desc(c) for c in BY_SCORE] if reverse else list(BY_SCORE)
    return zset.withColumn("rank", (F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1).cast("long"))


def zrange(zset: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Members between two ranks of each key, inclusive; negatives from the end.

    Without negatives the rank filter lets Spark keep only the first stop + 1 rows of each key and task.
    """
    ranked = zrank(zset, reverse)
    if start >= 0 and stop >= 0:
        return ranked.where(F.col("rank").between(start, stop))
    n = F.count("*").over(Window.partitionBy("key"))
    first = F.lit(start) if start >= 0 else n + start
    last = F.lit(stop) if stop >= 0 else n + stop
    counted = ranked.withColumn("first__", first).withColumn("last__", last)
    return counted.where("rank between first__ and last__").drop("first__", "last__")


def within(score: Column, low: str, high: str, strict: bool = True) -> Column:
    """Score bounds as text: "(" excludes, unless strict is off, when it is read and ignored."""
    ok = F.lit(True)
    for bound, above in ((low, True), (high, False)):
        open_bound = bound.startswith("(")
        value = float(bound.lstrip("("))
        if open_bound and strict:
            ok = ok & (score > value if above else score < value)
        else:
            ok = ok & (score >= value if above else score <= value)
    return ok


def zrangebyscore(zset: DataFrame, low: str, high: str) -> DataFrame:
    return zset.where(within(F.col("score"), low, high))


def zcount(zset: DataFrame, low: str, high: str) -> DataFrame:
    """Both bounds count as inclusive here."""
    return zset.where(within(F.col("score"), low, high, strict=False)).groupBy("key").agg(F.count("*").alias("n"))


def lex_within(member: Column, low: str, high: str) -> Column:
    """Byte order bounds: "-" and "+" are open ends, "[" includes, "(" excludes."""
    ok = F.lit(True)
    if low not in "-":
        ok = ok & (member >= low[1:] if low[0] == "[" else member > low[1:])
    if high not in "+":
        ok = ok & (member <= high[1:] if high[0] == "[" else member < high[1:])
    return ok


def zrangebylex(zset: DataFrame, low: str, high: str) -> DataFrame:
    return zset.where(lex_within(F.col("member"), low, high))


def zremrangebyrank(zset: DataFrame, start: int, stop: int) -> DataFrame:
    gone = zrange(zset, start, stop).select("key", "member")
    return zset.join(gone, ["key", "member"], "left_anti")


def zremrangebyscore(zset: DataFrame, low: str, high: str) -> DataFrame:
    return zset.where(~F.coalesce(within(F.col("score"), low, high), F.lit(False)))


def zpop(zset: DataFrame, n: int, largest: bool = False) -> DataFrame:
    return zrange(zset, 0, n - 1, reverse=largest).drop("rank")


def weighted(zset: DataFrame, weights: dict, how: str = "sum", every: bool = False) -> DataFrame:
    """Union of some keys, scores times weights, or with every their intersection; how: sum, min or max."""
    factor = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])
    some = zset.where(F.col("key").isin(list(weights))).withColumn("s", F.col("score") * factor[F.col("key")])
    agg = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    out = some.groupBy("member").agg(agg("s").alias("score"), F.count("*").alias("n__"))
    return (out.where(F.col("n__") == len(weights)) if every else out).drop("n__")


def zdiff(zset: DataFrame, first, rest: list) -> DataFrame:
    others = zset.where(F.col("key").isin(rest)).select("member").distinct()
    return zset.where(F.col("key") == first).select("member", "score").join(others, "member", "left_anti")


def zintercard(zset: DataFrame, keys: list, limit: int = 0) -> DataFrame:
    n = F.count("*")
    return weighted(zset, {k: 1 for k in keys}, every=True).agg((F.least(n, F.lit(limit)) if limit else n).alias("n"))


def zlexcount(zset: DataFrame, low: str, high: str) -> DataFrame:
    return zrangebylex(zset, low, high).groupBy("key").agg(F.count("*").alias("n"))


def zremrangebylex(zset: DataFrame, low: str, high: str) -> DataFrame:
    return zset.where(~lex_within(F.col("member"), low, high))


def zpage(zset: DataFrame, offset: int, count: int, reverse: bool = False, by_lex: bool = False) -> DataFrame:
    """LIMIT and REV of a score or lexical range: some rows of each key in its order."""
    order = [F.col("member")] if by_lex else [F.col("score"), F.col("member")]
    place = F.row_number().over(Window.partitionBy("key").orderBy(*[c.desc() if reverse else c for c in order]))
    return zset.withColumn("i__", place).where(F.col("i__").between(offset + 1, offset + count)).drop("i__")


def zstore(zset: DataFrame, target: str, found: DataFrame) -> DataFrame:
    """zset with target as the members and scores of found; the old target goes."""
    return zset.where(F.col("key") != target).select("key", "member", "score").unionByName(found.select(F.lit(target).alias("key"), "member", "score"))


def zadd_only(zset: DataFrame, writes: DataFrame, only: str) -> DataFrame:
    """zset after writes (key, member, score), one a member; only: nx, xx, gt or lt."""
    old = zset.select("key", "member", F.col("score").alias("was__"))
    both = old.join(writes.select("key", "member", "score"), ["key", "member"], "full_outer")
    known, new = F.col("was__").isNotNull(), F.col("score").isNotNull()
    wins = {
        "nx": new & ~known, "xx": new & known,
        "gt": new & (~known | (F.col("score") > F.col("was__"))), "lt": new & (~known | (F.col("score") < F.col("was__"))),
    }[only]
    return both.where(known | wins).select("key", "member", F.when(wins, F.col("score")).otherwise(F.col("was__")).alias("score"))
