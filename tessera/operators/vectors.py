"""Vectors: distances, exact neighbours, hashed embeddings, hybrid retrieval, graphs, memories and recommendations."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import retrieval_tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str) -> Column:
    """l2: squared; ip: the negative product; cosine: 1 less the cosine, 1 for a zero vector."""
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)
    if metric == "ip":
        return -dot(a, b)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms).otherwise(1.0)


def knn(table: DataFrame, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """(id, distance, score) of the nearest rows; each task keeps k, then the driver's plan merges them."""
    q = F.array(*[F.lit(float(x)) for x in query])
    near = table.withColumn("distance", distance(F.col("vec"), q, metric)).orderBy("distance", "id").limit(k)
    return near.select("id", "distance", (1 / (1 + F.col("distance"))).alias("score"))


def knn_join(queries: DataFrame, table: DataFrame, k: int, metric: str = "cosine", blocks: int = 16) -> DataFrame:
    """(query_id, id, distance, rank) for a stated query set, in blocks of the table: each block keeps k a query.

    A block is dealt by hash, so no vector decides its size; queries are copied to every block.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("vec").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    t = table.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    pairs = q.join(t, "block").where("query_id <> id").select("query_id", "id", "block", distance(F.col("vec"), F.col("q"), metric).alias("distance"))
    inner = F.row_number().over(Window.partitionBy("query_id", "block").orderBy("distance", "id"))
    best = pairs.withColumn("r", inner).where(F.col("r") <= k)
    outer = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return best.withColumn("rank", outer).where(F.col("rank") <= k).select("query_id", "id", "distance", "rank")


def fnv32(data: bytes) -> int:
    h = 0x811C9DC5
    for b in data:
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return h


def fnv64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def embed(dim: int = 384):
    """UDF: text to a normalised float vector of hashed words (weight 1) and letter trigrams of the padded text (0.5)."""
    def one(text: str | None):
        vec = np.zeros(dim, dtype=np.float32)
        text = (text or "").strip().lower()
        if text:
            padded = f" {text} "
            words = [fnv32(w.encode()) % dim for w in text.split()]
            grams = [fnv32(padded[i : i + 3].encode()) % dim for i in range(len(padded) - 2)]
            np.add.at(vec, words, np.float32(1.0))
            np.add.at(vec, grams, np.float32(0.5))
            vec /= np.float32(np.sqrt((vec.astype(np.float64) ** 2).sum()))
        return vec.tolist()

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run


def word_cell(word: str, dim: int) -> int:
    """A word's cell is told by the start of its MD5, so that SQL finds it too."""
    return int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % dim


def word_counts(words, dim: int = 64) -> list[int]:
    """The vector of some words: how many stand in each cell."""
    return np.bincount([word_cell(w, dim) for w in words], minlength=dim).tolist() if len(words) else [0] * dim


def hashed_words(dim: int = 64):
    """UDF: arrays of words to word_counts(); a batch's distinct words are hashed once."""
    @F.pandas_udf("array<double>")
    def run(words: pd.Series) -> pd.Series:
        cells = {w: word_cell(w, dim) for w in set(chain.from_iterable(words))}
        return words.map(lambda ws: np.bincount([cells[w] for w in ws], minlength=dim).astype(float) if len(ws) else np.zeros(dim))

    return run


def nearest_key(store: DataFrame, query: list[float], threshold: float = 0.75) -> DataFrame:
    """The stored value most similar to a query, if its cosine reaches the threshold."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = store.withColumn("score", 1 - distance(F.col("vec"), q, "cosine")).where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), "id").limit(1)


def bm25_leg(table: DataFrame, words: list[str], k1: float = 1.2, b: float = 0.0) -> DataFrame:
    """(id, score) over retrieval tokens; b = 0 leaves lengths aside."""
    tokens = table.select("id", retrieval_tokens(F.col("text")).alias("t"))
    facts = tokens.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean"))
    hits = tokens.select("id", F.size("t").alias("len"), F.explode(F.filter("t", lambda w: w.isin(words))).alias("term"))
    tf = hits.groupBy("id", "term", "len").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return tf.join(df, "term").join(F.broadcast(facts)).groupBy("id").agg(F.sum(idf * weight).alias("score"))


def retrieve(bm25: DataFrame, dense: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """Fusion of two scored legs (id, score) by reciprocal ranks; each leg gives its best max(4k, 32)."""
    depth = max(4 * k, 32)

    def leg(df: DataFrame, name: str) -> DataFrame:
        top = df.orderBy(F.desc("score"), "id").limit(depth)
        return top.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias(name))

    both = leg(bm25, "rank_bm25").join(leg(dense, "rank_vec"), "id", "full_outer")
    part = lambda name, w: F.coalesce(F.lit(w) / (60 + F.col(name)), F.lit(0.0))
    fused = both.withColumn("score", part("rank_bm25", 1 - alpha) + part("rank_vec", alpha))
    return fused.orderBy(F.desc("score"), "id").limit(k)


def neighbours(edges: DataFrame, node, predicate: str | None = None) -> DataFrame:
    some = edges.where(F.col("s") == node)
    return (some.where(F.col("p") == predicate) if predicate else some).select("p", "o").distinct()


def expand(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(s, p, o, depth): triples reached from start (node) in up to some hops, each with its least depth."""
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for hop in range(1, hops + 1):
        reached = edges.join(frontier, edges["s"] == frontier["node"]).select(F.col("o").alias("node")).distinct()
        frontier = reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(hop))
        seen = seen.union(frontier)
    found = edges.join(seen.where(F.col("depth") < hops), edges["s"] == F.col("node"))
    return found.groupBy("s", "p", "o").agg((F.min("depth") + 1).alias("depth"))


def path_length(edges: DataFrame, a, b, max_depth: int = 6) -> int | None:
    """Hops of a shortest path; None beyond max_depth. One row a hop comes back to decide."""
    frontier = edges.sparkSession.createDataFrame([(a,)], "node string")
    seen = frontier
    if a == b:
        return 0
    for hop in range(1, max_depth + 1):
        frontier = edges.join(frontier, edges["s"] == frontier["node"]).select(F.col("o").alias("node")).distinct().join(seen, "node", "left_anti")
        row = frontier.agg(F.bool_or(F.col("node") == b).alias("hit"), F.count("*").alias("n")).first()
        if row["hit"]:
            return hop
        if not row["n"]:
            return None
        seen = seen.union(frontier)
    return None


def recommend(likes: DataFrame, user, k: int) -> DataFrame:
    """Items that similar users weigh most and the user hasn't; similarity is the cosine of weight maps.

    likes holds one row a (user, item). Everything starts from the user's own items, so no pair of other users is made.
    """
    mine = likes.where(F.col("user") == user)
    norms = likes.groupBy("user").agg(F.sqrt(F.sum(F.pow("weight", 2))).alias("norm"))
    own = mine.select("item", F.col("weight").alias("w0"))
    dots = likes.where(F.col("user") != user).join(own, "item").groupBy("user").agg(F.sum(F.col("weight") * F.col("w0")).alias("dot"))
    me = norms.where(F.col("user") == user).select(F.col("norm").alias("n0"))
    sims = dots.join(norms, "user").join(F.broadcast(me)).select("user", (F.col("dot") / (F.col("norm") * F.col("n0"))).alias("sim"))
    fresh = likes.join(sims.where("sim > 0"), "user").join(own.select("item"), "item", "left_anti")
    return fresh.groupBy("item").agg(F.sum(F.col("sim") * F.col("weight")).alias("score")).orderBy(F.desc("score"), "item").limit(k)


def memory_blend(cosine: Column, importance: Column, age_days: Column, recency: float) -> Column:
    return (1 - recency) * cosine + recency * F.greatest(importance, F.exp(-age_days / 30))


def consolidate(notes: DataFrame, threshold: float = 0.85, least: int = 3):
    """Greedy clusters of each user's notes (user, text, vec, importance, created): big ones become one summary.

    Order decides, so a user's notes are folded in one task, as they come.
    """
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["created", "text"])
        vecs = np.stack(frame["vec"].to_numpy())
        left, rows = list(range(len(frame))), []
        while left:
            seed = left[0]
            close = [i for i in left if i == seed or float(vecs[i] @ vecs[seed]) >= threshold]
            left = [i for i in left if i not in set(close)]
            if len(close) >= least:
                best = sorted(close, key=lambda i: -frame["importance"].iat[i])[:5]
                rows.append((frame["user"].iat[0], "; ".join(frame["text"].iat[i] for i in best), len(close)))
        return pd.DataFrame(rows, columns=["user", "summary", "merged"])

    return notes.groupBy("user").applyInPandas(run, "user string, summary string, merged long")
