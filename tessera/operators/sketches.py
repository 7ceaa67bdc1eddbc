"""Distinct counts, membership, frequencies and heavy hitters: exact forms, and bounded sketches that merge."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_sketch(rows: DataFrame, key: str, item: str, log_k: int = 14) -> DataFrame:
    """(key, sketch): HyperLogLog of the items; merge with merged_count."""
    return rows.groupBy(key).agg(F.hll_sketch_agg(item, log_k).alias("sketch"))


def merged_count(sketches: DataFrame) -> DataFrame:
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def hash_slots(item, depth: int, width: int):
    """depth independent places of an item among width."""
    return F.array(*[F.pmod(F.xxhash64(item, F.lit(i)), F.lit(width)) for i in range(depth)])


def bloom_shape(capacity: int, error: float) -> tuple[int, int]:
    """(bits, hashes) of a Bloom filter."""
    bits = max(64, math.ceil(-capacity * math.log(error) / math.log(2) ** 2))
    return bits, max(1, round(bits / capacity * math.log(2)))


def bloom(rows: DataFrame, item: str, capacity: int, error: float = 0.01) -> DataFrame:
    """The filter's set bits as bitmaps by bucket: (bucket, bits); filters of one shape merge by bitmap_or_agg."""
    bits, hashes = bloom_shape(capacity, error)
    places = rows.select(F.explode(hash_slots(F.col(item), hashes, bits)).alias("p"))
    return places.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))


def bloom_contains(probes: DataFrame, item: str, rows: DataFrame, capacity: int, error: float = 0.01) -> DataFrame:
    """probes with maybe: false only where the item certainly isn't among rows. Set places are joined by hash."""
    bits, hashes = bloom_shape(capacity, error)
    places = rows.select(F.explode(hash_slots(F.col(item), hashes, bits)).alias("p")).distinct()
    asked = probes.select(item).distinct().select(item, F.explode(hash_slots(F.col(item), hashes, bits)).alias("p"))
    hits = asked.join(places, "p", "left_semi").groupBy(item).agg(F.count("*").alias("hits"))
    want = asked.groupBy(item).agg(F.count("*").alias("want"))
    maybe = want.join(hits, item, "left").select(item, (F.coalesce("hits", F.lit(0)) == F.col("want")).alias("maybe"))
    return probes.join(maybe, item)


def multiset(log: DataFrame) -> DataFrame:
    """Exact counts with deletion of a log (item, delta); counts stay at 0 or above."""
    return log.groupBy("item").agg(F.greatest(F.sum("delta"), F.lit(0)).alias("n"))


def count_min(rows: DataFrame, item: str, error: float = 0.01, probability: float = 0.01) -> DataFrame:
    """(row, slot, n): a count-min table of ceil(e / error) by ceil(ln(1 / probability)); tables add up to merge."""
    width, depth = math.ceil(math.e / error), math.ceil(math.log(1 / probability))
    slots = rows.select(F.posexplode(hash_slots(F.col(item), depth, width)).alias("row", "slot"))
    return slots.groupBy("row", "slot").agg(F.count("*").alias("n"))


def count_min_query(table: DataFrame, probes: DataFrame, item: str, error: float = 0.01, probability: float = 0.01) -> DataFrame:
    """probes with n, never below the true count."""
    width, depth = math.ceil(math.e / error), math.ceil(math.log(1 / probability))
    asked = probes.select(item, F.posexplode(hash_slots(F.col(item), depth, width)).alias("row", "slot"))
    return asked.join(table, ["row", "slot"], "left").groupBy(item).agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))


def top_k(rows: DataFrame, item: str, k: int) -> DataFrame:
    counted = rows.groupBy(item).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), item).limit(k)


def dedup_window(events: DataFrame, window_ms: int) -> DataFrame:
    """events (bucket, id, ts) with fresh: 1 for the first sight of an id, or after a gap longer than the window."""
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("bucket", "id").orderBy("ts"))
    return events.withColumn("fresh", F.when(before.isNull() | (F.col("ts") - before > window_ms), 1).otherwise(0))
