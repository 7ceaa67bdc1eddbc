"""What op8 does once: splitting texts; rounds of heads only where buckets have many pairs; links added to components."""

import random

from pyspark.sql import functions as F

from tessera.llm import line_dedup as L


def bunch(n=40):
    """Lines of one template, of which some pairs reach the threshold."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        own = list(base)
        for k in rng.sample(range(60), rng.randint(1, 6)):
            own[k] = word()
        rows.append((i, " ".join(own)))
    return rows


def gone(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: r.lines_gone for r in L.deduplicated(docs).collect()}


def test_texts_are_split_once_and_few_pairs_need_no_rounds(spark, monkeypatch):
    made, calls = L.lines_of, []
    monkeypatch.setattr(L, "SMALL", 3)
    with monkeypatch.context() as m:
        m.setattr(L, "PAIRS", -1)
        rounds = gone(spark, bunch())
    real = L.cut
    monkeypatch.setattr(L, "cut", lambda df, tag: (calls.append(tag), real(df, tag))[1])
    monkeypatch.setattr(L, "lines_of", lambda *a: (calls.append("lines_of"), made(*a))[1])
    monkeypatch.setattr(L, "mixed_pairs", None)
    direct = gone(spark, bunch())
    assert direct == rounds and sum(direct.values())
    assert calls.count("line-seen") == calls.count("lines_of") == 1 and "bucket-others" in calls


def test_further_links_join_components(spark):
    rng = random.Random(9)
    pairs = lambda n, m: [(min(a, b), -min(a, b), max(a, b), -max(a, b)) for a, b in (rng.sample(range(m), 2) for _ in range(n))]
    schema = "a long, a2 long, b long, b2 long"
    first, more = (spark.createDataFrame(sorted(set(pairs(n, 60))), schema) for n in (20, 12))
    want = sorted(L.rooted(first.union(more)).collect())
    assert sorted(L.extended(L.rooted(first), more).collect()) == want
    assert L.extended(L.rooted(first), more).groupBy("k1", "k2").count().where(F.col("count") > 1).isEmpty()
