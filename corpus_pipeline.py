"""A training corpus from documents: quality, line dedup, near-dedup, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns the columns of documents, the last one pieces of packed sequences. run() applies them to documents, each stage's
result written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import host_quality, line_dedup, mixing, near_text, packing
from tessera.storage import cut, release


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules keep."""
    return host_quality.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that other documents have already; those that lose all lines go."""
    kept = line_dedup.keep_lines(docs)
    sizes = {c: F.length(kept["text"]).cast(docs.schema[c].dataType) for c in docs.columns if c == "n_chars"}
    return kept.select(*[sizes[c].alias(c) if c in sizes else kept[c] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose word shingles of five have a similarity of 0.8 or more."""
    return near_text.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the sources' target weights ask for."""
    return mixing.repeat_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 ids, with their ids."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: SQL can express neither line clusters, fingerprints, mixing nor packing; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark)
    return docs
