"""Connected components by alternating large-star and small-star contraction, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.storage import cut, drop, release


def _told(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges written, and their count and hash, which the write itself adds up: no further jobs for the driver to keep."""
    seen = Observation()
    out = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "cc")
    return out, (seen.get["n"], seen.get["h"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b: long, any direction) to (node, root), root the smallest node reachable.

    Nodes that have no edge to another node are absent. Minima are pre-aggregated before the shuffle, so a hub
    costs one row per task; the join back to a hub's edges is a sort-merge join that adaptive execution splits.
    Each round is written to the shared folder, so a lost executor costs one round at most.
    """
    now, state = _told(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # no more rows than edges, though some repeat: the next step drops these
        step = cut(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "cc")
        low = step.groupBy("a").agg(F.min("b").alias("m"))
        small = step.join(low, "a")
        before = state
        after, state = _told(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .union(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        drop(now, step)
        now = after
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    # many plans end here; what the driver still holds of them would make its heap grow
    release(edges.sparkSession)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
