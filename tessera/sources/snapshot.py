"""Snapshots and append-only logs of keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.keyspace import replay


def save(spaces: dict[str, DataFrame], path: str) -> None:
    """One folder a type; a rerun replaces the snapshot."""
    for kind, table in spaces.items():
        table.write.mode("overwrite").parquet(f"{path}/type={kind}")


def load(spark: SparkSession, path: str, kinds: list[str]) -> dict[str, DataFrame]:
    return {kind: spark.read.parquet(f"{path}/type={kind}") for kind in kinds}


def append(log: DataFrame, path: str) -> None:
    """Append writes (seq, key, value, op) to a log."""
    log.write.mode("append").parquet(path)


def rewrite(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Compact a log to its current state, written as a log of its own."""
    state = replay(spark.read.parquet(path))
    numbered = state.select(F.lit(0).cast("long").alias("seq"), "key", "value", F.lit("set").alias("op"))
    numbered.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def dump(space: DataFrame) -> DataFrame:
    """(key, blob): each row as JSON text."""
    return space.select("key", F.to_json(F.struct("*")).alias("blob"))


def restore(blobs: DataFrame, schema) -> DataFrame:
    return blobs.select(F.from_json("blob", schema).alias("r")).select("r.*")
