"""Shared-folder tables: how long plans are cut so that lost executors cost a re-read, not a re-run."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, else the context's, else (local tests) a fresh one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tessera/{tag}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: a new, short lineage with known sizes.

    What the write shuffled is removed as soon as the table stands.
    """
    return _written(df, tag, compression="zstd")


def cut_quick(df: DataFrame, tag: str) -> DataFrame:
    """cut() for tables of hashes and lines, which hardly repeat: without dictionaries, and a codec that is quick rather than dense."""
    return _written(df, tag, **{"compression": "snappy", "parquet.enable.dictionary": "false"})


def _written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_tessera_path", None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove what plans that nothing refers to any more have left."""
    gc.collect()
    spark._jvm.System.gc()
