"""Mixing sources to target weights by entropy balancing.

Documents get rates that stay as close to 1 as they can, in relative entropy over tokens, while every source's expected
tokens meet its target: the minimum of sum(size * (r log r - r + 1)) subject to sum over the source of size * r = target.
Its convex dual has one multiplier a source, the rates are exponentially tilted, r = exp(lambda), and the dual is solved
by Newton steps on aggregated token sums, for all sources at once and without collecting them.

Rates become whole copies by error diffusion: a source's documents are dealt into buckets by hash, each bucket runs from
its largest document to its smallest, and every document takes the lower or the upper whole number of copies, whichever
brings the running total closer to what it should be. So each bucket ends within about half its smallest documents of its
share. No document gets more than CAP copies. All choices depend on the data alone, so reruns agree.

Null texts have size 0 and are never copied more than once; null sources are one source, the last. Documents of size 0
take no words and keep one copy in the mixed table. Equal rows are separate documents, told apart by nothing, so they
are dealt as interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BUCKET_ROWS = 2048
NEWTON_STEPS = 40


def sizes(docs: DataFrame, text_col: str = "text") -> F.Column:
    """Words of a text, as whitespace of ASCII separates them."""
    return F.coalesce(F.regexp_count(docs[text_col], F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ordered_index(table: DataFrame, key: str) -> DataFrame:
    """table with i, its row number from 0 by key (UTF-8 order, nulls last), without one task that sees all rows."""
    ranged = cut(
        table.repartitionByRange(F.col(key).asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ordered"
    )
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    offsets, total = {}, 0
    for part in sorted(counts):
        offsets[part], total = total, total + counts[part]
    local = F.row_number().over(Window.partitionBy("part").orderBy(F.col(key).asc_nulls_last())) - 1
    if not offsets:
        return ranged.select(*table.columns, F.lit(0).cast("long").alias("i"))
    base = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])[F.col("part")]
    return ranged.select(*table.columns, (local + base).cast("long").alias("i"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources (source, tokens, n) with weight and target; targets above cap times the tokens are reshared by weight.

    Only the level that all open sources share by weight comes to the driver: a source is at its cap or at
    level * weight, and the level rises until all is dealt.
    """
    ranked = ordered_index(sources, "source")
    wheel = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    held = cut(ranked.withColumn("weight", wheel).drop("i"), "sources")
    total = held.agg(F.sum("tokens")).first()[0] or 0
    level, budget = 0.0, share * total
    while True:
        over = (F.col("weight") * level > cap * F.col("tokens")) if level else F.lit(False)
        row = held.agg(
            F.sum(F.when(over, cap * F.col("tokens")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        new = (budget - row["fixed"]) / row["open"] if row["open"] else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return held.withColumn("target", F.least(F.col("weight") * level, cap * F.col("tokens").cast("double")))


def tilts(sources: DataFrame, cap: float = CAP, steps: int = NEWTON_STEPS) -> DataFrame:
    """sources with lambda and rate = exp(lambda), by Newton steps on each source's dual.

    The dual of a source is tokens * exp(l) - target * l; its Newton step is l - 1 + target / (tokens * exp(l)), held to
    one unit upwards so that small rates are approached safely. It is convex and smooth; the steps run inside one
    expression over the source table.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("target") / F.col("tokens")).otherwise(1.0)
    step = lambda l, _: l + F.greatest(F.least(ratio * F.exp(-l) - 1, F.lit(1.0)), F.lit(-1.0))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)
    return sources.withColumn("lambda", found).withColumn("rate", F.least(F.exp("lambda"), F.lit(float(cap))))


def copies_of(size: np.ndarray, rate: np.ndarray, cap: int = CAP) -> np.ndarray:
    """Whole copies of one bucket's documents, which come from the largest to the smallest."""
    out = np.zeros(len(size), dtype=np.int64)
    error = 0.0
    low = np.floor(rate)
    high = np.minimum(np.ceil(rate), cap)
    for i in range(len(size)):
        if size[i] == 0:
            out[i] = 1
            continue
        want = rate[i] * size[i] + error
        out[i] = min(max(np.floor(want / size[i] + 0.5), low[i]), high[i])
        error = want - out[i] * size[i]
    return out


def mixed(docs: DataFrame, keys: list[str], source_col: str = "source", text_col: str = "text", cap: int = CAP, **how) -> DataFrame:
    """keys, size, source_size, target, copies and taken for every row."""
    held = cut(
        docs.select(*keys, docs[source_col].alias("source__"), sizes(docs, text_col).alias("size")), "mix-sizes"
    )
    sources = held.groupBy(F.col("source__").alias("source")).agg(F.sum("size").alias("tokens"), F.count("*").alias("n"))
    told = cut(tilts(targets(sources, cap=cap, **how), cap), "mix-rates")
    joined = held.join(told, held["source__"].eqNullSafe(told["source"]))
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    dealt = joined.select(
        *[held[k] for k in keys],
        "size",
        F.col("tokens").alias("source_size"),
        "target",
        "rate",
        F.xxhash64("source__").alias("s__"),
        F.pmod(F.xxhash64(*[held[k].cast("string") for k in keys], "size"), buckets).alias("b__"),
    )
    order = [*keys]

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", *order], ascending=False, kind="stable")
        frame["copies"] = copies_of(frame["size"].to_numpy(), frame["rate"].to_numpy(), cap)
        frame["taken"] = frame["copies"] * frame["size"]
        return frame.drop(columns=["s__", "b__", "rate"])

    schema = dealt.drop("s__", "b__", "rate").schema.simpleString()[7:-1] + ",copies:bigint,taken:bigint"
    return dealt.groupBy("s__", "b__").applyInPandas(deal, schema)


def repeat_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with their columns; rows without words stay once.

    Rates are dealt by a hash of the whole row, so equal rows share their copies' counts, and only the hash and the
    counts are shuffled beside the documents.
    """
    key = F.xxhash64(*[docs[c].cast("string") for c in docs.columns])
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("k__"))
    keyed = docs.select(*[docs[c] for c in docs.columns], key.alias("k__"))
    counts = mixed(keyed, ["k__"], **how).groupBy("k__").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    joined = marked.join(counts, "k__")
    turn = F.row_number().over(Window.partitionBy("k__").orderBy(F.lit(1))) - 1
    each = F.floor(F.col("copies") / F.col("rows")) + (F.col("turn__") < F.col("copies") % F.col("rows")).cast("long")
    numbered = joined.withColumn("turn__", turn).withColumn("n__", each.cast("int")).where("n__ > 0")
    return numbered.select(F.explode(F.array_repeat("row", F.col("n__"))).alias("row")).select("row.*")


def op7_entropy_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixed(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")
