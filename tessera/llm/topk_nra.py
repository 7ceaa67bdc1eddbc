"""Exact top-k inner products by no-random-access aggregation.

A shard holds its rows as one sorted list per component. The lists are read sequentially in rounds, from the high end
for query components above zero and from the low end for those below; a block of queries shares each read. After a round
a row's upper bound takes, for every component not yet read, the value the list has reached; its lower bound takes the
list's other end. A query stops reading once no row that isn't resolved could reach its k-th lower bound; rows that tie
with it stay. Rows whose upper bound reaches the k-th lower bound are then resolved to final scores.

Components become floor(64 * x) as long; bounds are summed in float64 with room for its rounding, final scores in 64-bit
integers (scores beyond these aren't representable in the result). Shards have a fixed number of rows and
query blocks a fixed number of queries; every pair of block and shard is one task's group, and each returns k rows a
query, which are merged by one ranked aggregation. Shards are dealt by hash of the id, so equal vectors spread.

Rows without id, null vectors and vectors with null or non-finite components take no part; empty
vectors don't either. Vectors of different lengths have no product, so each length is searched for itself. Ties go to
the smaller id. Rows that repeat an id are separate candidates, but the id asks once, with the least of its vectors.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import cut

SHARD_ROWS = 4096
BLOCK_QUERIES = 512
#: Share of each list that is read by the end of each round.
DEPTHS = (0.25, 0.5, 1.0)


def nra(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (row index, score) of all rows that may be among its k best of this shard, scores exact.

    own: for each query the indices of rows that are the query itself. floor: for each query a score that k rows
    elsewhere reach already.
    """
    n, dims = rows.shape
    x = rows.astype(np.float64)
    order = np.argsort(rows, axis=0, kind="stable")
    ends = np.take_along_axis(x, order, axis=0)
    least, most = ends[0], ends[-1]
    high, low = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    read_top, read_low = np.zeros((n, dims), bool), np.zeros((n, dims), bool)
    out: list = [None] * len(queries)
    active = np.arange(len(queries))
    floor = np.full(len(queries), -np.inf) if floor is None else floor
    done = 0
    columns = np.arange(dims)
    for depth in DEPTHS:
        upto = min(n, int(np.ceil(depth * n)))
        read_top[order[n - upto : n - done], columns] = True
        read_low[order[done:upto], columns] = True
        done = upto
        top_at, low_at = ends[n - upto], ends[upto - 1]
        upper = high[active] @ np.where(read_top, x, top_at).T + low[active] @ np.where(read_low, x, low_at).T
        lower = high[active] @ np.where(read_top, x, least).T + low[active] @ np.where(read_low, x, most).T
        for j, q in enumerate(active):
            upper[j, own[q]] = lower[j, own[q]] = -np.inf
        if n > k:
            bound = np.maximum(floor[active], np.partition(lower, n - k, axis=1)[:, n - k])
            bound = bound - 1e-9 * np.abs(bound)  # the bounds are rounded, the scores aren't
        else:
            bound = np.full(len(active), -np.inf)
        able = (upper >= bound[:, None]) & (upper > -np.inf)
        few = able.sum(axis=1) <= max(8 * k, n // 16)
        settle = np.ones(len(active), bool) if depth == DEPTHS[-1] else few
        for j in np.flatnonzero(settle):
            rest = np.flatnonzero(able[j])
            out[active[j]] = (rest, rows[rest].astype(np.int64) @ queries[active[j]].astype(np.int64))
        active = active[~settle]
        if not len(active):
            break
    return out


def top_k(table: DataFrame, id_col: str, vector_col: str, is_query: F.Column, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that is_query marks, against all other rows."""
    spark = table.sparkSession
    v = F.col("v__")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    held = table.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v__"), is_query.alias("q__")
    ).where("id is not null and v__ is not null").where(finite)
    held = cut(held.select("id", "q__", F.size("v__").alias("d"), F.transform("v__", lambda e: F.floor(scale * e).cast("long")).alias("v")), "vectors")
    held = held.where("d > 0")
    stats = held.agg(F.count("*").alias("n"), F.sum(F.col("q__").cast("long")).alias("q")).first()
    schema = "query_id long, vec_id long, score long"
    if not stats["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards, blocks = -(-stats["n"] // SHARD_ROWS), -(-stats["q"] // BLOCK_QUERIES)
    rows = held.select(
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).alias("s"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.lit(False).alias("q"), "id", "d", "v",
    )
    # an id that stands in several rows asks once, with the least of its vectors
    asked = held.where("q__").groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v")).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("s"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).alias("b"), F.lit(True).alias("q"), "id", "d", "v",
    )

    def pair(frame: pd.DataFrame) -> pd.DataFrame:
        ask, give = frame[frame["q"]], frame[~frame["q"]].sort_values("id")
        if not len(ask) or not len(give):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        ids = give["id"].to_numpy()
        asked_ids = ask["id"].to_numpy()
        own = [np.arange(*np.searchsorted(ids, [i, i + 1])) for i in asked_ids]
        found = nra(np.stack(ask["v"].to_numpy()), np.stack(give["v"].to_numpy()), own, k)
        best = [(rest[o], s[o]) for rest, s in found for o in [np.lexsort((ids[rest], -s))[:k]]]
        return pd.DataFrame({
            "query_id": np.repeat(asked_ids, [len(r) for r, _ in best]),
            "vec_id": ids[np.concatenate([r for r, _ in best])],
            "score": np.concatenate([s for _, s in best]),
        })

    found = rows.union(asked).groupBy("s", "b", "d").applyInPandas(pair, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nra_top_k(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(table, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20)
