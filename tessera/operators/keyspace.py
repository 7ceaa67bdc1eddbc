"""Keys: scans, globs, expiry, digests, sorting and eviction over keyed tables.

A keyspace is a DataFrame with key, a value column and, where keys can expire, expire_ms (null: never).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.num import go_float


def glob_regex(pattern: str) -> str:
    """A glob of *, ? and [set] as an anchored regular expression; sets are literal, without ranges or negation."""
    out, at = "", 0
    while at < len(pattern):
        ch = pattern[at]
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif ch == "[":
            end = pattern.find("]", at + 1)
            if end < 0:
                return r"(?!)"
            out += "[" + "".join(c if c.isalnum() else "\\" + c for c in pattern[at + 1 : end]) + "]" if end > at + 1 else r"(?!)"
            at = end
        else:
            out += "\\" + ch if not ch.isalnum() else ch
        at += 1
    return f"(?s)^{out}$"


def keys(space: DataFrame, pattern: str) -> DataFrame:
    return space.where(F.col("key").rlike(glob_regex(pattern))).select("key")


def mget(space: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (pos, key) with its value, null where there is none."""
    return wanted.join(space.select("key", "value"), "key", "left").select("pos", "key", "value")


def scan(space: DataFrame, cursor: int = 0, count: int = 10, pattern: str | None = None) -> DataFrame:
    """One page of keys in key order: the window is cut first, the pattern applies inside it.

    Pages come from a global sort and a limit, so no single task numbers all keys.
    """
    page = space.select("key").orderBy("key").offset(cursor).limit(count)
    return page.where(F.col("key").rlike(glob_regex(pattern))) if pattern else page


def exists(space: DataFrame, wanted: DataFrame) -> DataFrame:
    """How many of the wanted keys exist; a key asked twice counts twice."""
    return wanted.join(space.select("key").distinct(), "key", "left_semi").agg(F.count("*").alias("n"))


def delete(space: DataFrame, gone: DataFrame) -> DataFrame:
    return space.join(gone.select("key").distinct(), "key", "left_anti")


def live(space: DataFrame, now_ms: Column) -> DataFrame:
    return space.where(F.col("expire_ms").isNull() | (F.col("expire_ms") > now_ms))


def pttl(expire_ms: Column, now_ms: Column) -> Column:
    """Remaining milliseconds; -1 without expiry."""
    return F.when(expire_ms.isNull(), F.lit(-1)).otherwise(expire_ms - now_ms).cast("long")


def expire(space: DataFrame, which: Column, at_ms: Column) -> DataFrame:
    return space.withColumn("expire_ms", F.when(which, at_ms).otherwise(F.col("expire_ms")))


def persist(space: DataFrame, which: Column) -> DataFrame:
    return space.withColumn("expire_ms", F.when(which, F.lit(None)).otherwise(F.col("expire_ms")))


def rename(space: DataFrame, source: str, target: str, only_new: bool = False) -> DataFrame:
    """Relabel source as target; an existing target goes, or with only_new stops the move."""
    if only_new:
        taken = space.where(F.col("key") == target).select(F.lit(True).alias("taken__")).limit(1)
        space = space.join(F.broadcast(taken), how="left")
        moved = F.when((F.col("key") == source) & F.col("taken__").isNull(), F.lit(target)).otherwise(F.col("key"))
        return space.withColumn("key", moved).drop("taken__")
    kept = space.where(F.col("key") != target)
    return kept.withColumn("key", F.when(F.col("key") == source, F.lit(target)).otherwise(F.col("key")))


def copy(space: DataFrame, source: str, target: str) -> DataFrame:
    kept = space.where(F.col("key") != target)
    return kept.unionByName(space.where(F.col("key") == source).withColumn("key", F.lit(target)))


def replay(log: DataFrame) -> DataFrame:
    """Last write of each key from an append-only log (seq, key, value, op); deleted keys go."""
    last = log.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("w"))
    return last.where("w.op <> 'del'").select("key", F.col("w.value").alias("value"))


def encoding(value: Column) -> Column:
    """Encoding label of a string value."""
    return (
        F.when(F.try_to_number(value, F.lit("S9999999999999999999")).isNotNull() & value.rlike(r"^[+-]?\d+$"), "int")
        .when(F.octet_length(value) <= 44, "embstr")
        .otherwise("raw")
    )


def digest_string(value: Column) -> Column:
    return F.sha1(F.concat(F.lit("S:"), value).cast("binary"))


def digest_members(prefix: str, members: Column) -> Column:
    """Order-independent digest of a set's members (prefix X:), or ordered digest of a list's (L:)."""
    ordered = F.array_sort(members) if prefix == "X:" else members
    return F.sha1(F.concat(F.lit(prefix), F.array_join(F.transform(ordered, lambda m: F.concat(m, F.lit("\0"))), "")).cast("binary"))


def sort_by(items: DataFrame, lookup: DataFrame | None = None, descending: bool = False, alpha: bool = False) -> DataFrame:
    """items (pos, item) ordered by themselves or by lookup (item, weight): unparsable numbers are 0, ties keep order."""
    joined = items.join(lookup, "item", "left") if lookup is not None else items.withColumn("weight", F.col("item"))
    weight = F.coalesce(F.col("weight"), F.lit("")) if alpha else F.coalesce(go_float(F.col("weight")), F.lit(0.0))
    ordered = joined.withColumn("weight", weight)
    return ordered.orderBy(F.col("weight").desc() if descending else F.col("weight"), "pos")


def eviction_score(hits: Column, age_seconds: Column, size: Column) -> Column:
    """Low scores go first: frequency and recency keep an entry, size counts against it."""
    return hits * 0.40 + 0.35 / (1 + age_seconds / 3600.0) - size / 1024.0 * 0.25


def victims(space: DataFrame, score: Column, n: int) -> DataFrame:
    return space.withColumn("score", score).orderBy("score", "key").limit(n)


def crc16(key: str) -> int:
    """CRC16 (XMODEM polynomial) of a key's bytes."""
    crc = 0
    for byte in key.encode():
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


def slot(key: str) -> int:
    """Hash slot of a key; the first non-empty {tag} stands for the key."""
    start = key.find("{")
    end = key.find("}", start + 1) if start >= 0 else -1
    return crc16(key[start + 1 : end] if end > start + 1 else key) % 16384


def key_slot() -> object:
    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None else slot(k))

    return run


def slot_stats(space: DataFrame, limit: int) -> DataFrame:
    """The fullest slots."""
    counted = space.groupBy(key_slot()(F.col("key")).alias("slot")).agg(F.count("*").alias("keys"))
    return counted.orderBy(F.desc("keys"), "slot").limit(limit)


def put(space: DataFrame, writes: DataFrame, only_new: bool = False, only_known: bool = False, keep_expiry: bool = False) -> DataFrame:
    """space (key, value, expire_ms) after writes of the same columns, one a key; keep_expiry leaves the old moment."""
    old = space.select("key", F.col("value").alias("old__"), F.col("expire_ms").alias("was__"), F.lit(True).alias("known__"))
    both = old.join(writes.select("key", "value", "expire_ms", F.lit(True).alias("new__")), "key", "full_outer")
    known, new = F.col("known__").isNotNull(), F.col("new__").isNotNull()
    wins = new & ~known if only_new else new & known if only_known else new
    expire = F.when(known, F.col("was__")).otherwise(F.col("expire_ms")) if keep_expiry else F.col("expire_ms")
    return both.where(known | wins).select(
        "key", F.when(wins, F.col("value")).otherwise(F.col("old__")).alias("value"), F.when(wins, expire).otherwise(F.col("was__")).alias("expire_ms")
    )


def put_all_or_none(space: DataFrame, writes: DataFrame) -> DataFrame:
    """space after writes, none of which count if one of their keys exists."""
    taken = writes.join(space.select("key"), "key", "left_semi").agg((F.count("*") > 0).alias("taken__"))
    able = writes.join(F.broadcast(taken)).where("not taken__").select(writes.columns)
    return space.select("key", "value", "expire_ms").unionByName(able.select("key", "value", "expire_ms"))


def get_and_put(space: DataFrame, writes: DataFrame) -> DataFrame:
    """writes' keys with the value that each replaces, null where there was none."""
    return writes.select("key").join(space.select("key", "value"), "key", "left")


def get_and_delete(space: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The wanted keys' values, and space without them."""
    return get_and_put(space, wanted), delete(space, wanted)


def move(space: DataFrame, which: Column, target: int) -> DataFrame:
    """space (db, key, …) with the rows that which picks in another database, unless it has the key already."""
    there = space.where(F.col("db") == target).select("key", F.lit(True).alias("there__"))
    goes = which & (F.col("db") != target) & F.col("there__").isNull()
    return space.join(there, "key", "left").withColumn("db", F.when(goes, F.lit(target)).otherwise(F.col("db"))).select(space.columns)


def swap_databases(space: DataFrame, a: int, b: int) -> DataFrame:
    return space.withColumn("db", F.when(F.col("db") == a, b).when(F.col("db") == b, a).otherwise(F.col("db")))


def scan_elements(table: DataFrame, element: str, cursor: int = 0, count: int = 10, pattern: str | None = None) -> DataFrame:
    """One page of every key's fields or members in their order; the pattern applies inside the page."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(element))
    page = table.withColumn("i__", place).where(F.col("i__").between(cursor + 1, cursor + count)).drop("i__")
    return page.where(F.col(element).rlike(glob_regex(pattern))) if pattern else page
