"""The near-dedup stage takes operator 1's fingerprints and its grid join as a step."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import near_text, simhash


def texts():
    rng = random.Random(11)
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]
    return [(1, " ".join(base)), (2, " ".join([*base, "end"])), (3, " ".join(f"v{rng.randrange(3000)}" for _ in range(300)))]


def test_fingerprints_are_operator_ones():
    for _, text in [*texts(), (4, "one two"), (5, "a b c d e f g " * 9)]:
        assert simhash.fingerprint_of(near_text.shingle_hashes(text.encode())) == simhash.simhash(text.encode(), 5)


def test_grid_join_proposes(spark, monkeypatch):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    found = {r.doc_id: r.id for r in near_text.marked(near_text._texts(docs, "doc_id", "text"), 5).collect()}
    nodes = near_text.marked(near_text._texts(docs, "doc_id", "text"), 5).select("id", "fp")
    assert {tuple(r) for r in near_text.fingerprint_pairs(nodes).collect()} == {tuple(sorted((found[1], found[2])))}
    # without any band the fingerprints alone find the near copy
    monkeypatch.setattr(near_text, "band_keys", lambda x: x.select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("o"), "k1").where("false"))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]
