"""The near-dedup stage compares every two texts of a bucket that aren't in one group already."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import near_text
from tessera.llm.line_dedup import BINS, SMALL, WORDS


def test_no_pair_of_a_bucket_is_left_out(spark, monkeypatch):
    rng = random.Random(3)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(2 * SMALL)]
    name = lambda text: near_text.set_id(near_text.shingle_set(text.encode()))
    texts.sort(key=lambda words: name(" ".join(words)))
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    # a copy far from its text in the order of names, neither of them at an end
    copies = (" ".join([*texts[SMALL], f"end{k}"]) for k in range(100))
    copy = next(c for c in copies if name(rows[2][1]) < name(c) < name(rows[SMALL - 3][1]))
    docs = spark.createDataFrame([*rows, (99, copy)], "doc_id long, text string")
    real = near_text.marked
    # five bins are equal in all texts, which share the first band and no other
    bins = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: F.when(k.isin(0, 1, 2, 3, 5), 1).otherwise(F.shiftrightunsigned(F.xxhash64("id", k), 34).cast("int")))
    monkeypatch.setattr(near_text, "marked", lambda texts, width: real(texts, width).withColumn("bins", bins))
    monkeypatch.setattr(near_text, "fingerprint_pairs", lambda nodes: nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false"))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows}


def test_sketch_differs_in_no_more_cells_than_the_sets():
    rng = np.random.default_rng(7)
    for n in (0, 1, 5, 300, 20_000):
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(-(2**63), 2**63 - 1, n // 10)]))
        apart = near_text.sketch(a) ^ near_text.sketch(b)
        assert len(apart) == WORDS
        assert int(np.bitwise_count(apart.view(np.uint64)).sum()) <= len(np.setxor1d(a, b))
