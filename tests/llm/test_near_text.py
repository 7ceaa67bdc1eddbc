"""The pipeline's near-dedup stage against all pairs, by exact Jaccard of five-word shingles."""

import random

import pytest

import corpus_pipeline
from tessera.llm import near_text, simhash


def slow_set(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def slow_kept(rows):
    sets = {i: slow_set(t) for i, t in rows}
    alike = lambda a, b: a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and alike(sets[a], sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def near_copies():
    """Texts with copies at similarities on both sides of 0.8, a passage that many share, short and empty texts."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(2000)]
    passage = " ".join(rng.choices(vocab, k=30))
    bases = [rng.choices(vocab, k=rng.randint(20, 200)) for _ in range(40)]
    texts = [" ".join(b) for b in bases]
    for b in bases:
        for share in (0.005, 0.015, 0.02, 0.03):
            copy = list(b)
            for k in rng.sample(range(len(b)), max(1, round(share * len(b)))):
                copy[k] = "changed"
            texts.append(" ".join(copy))
    texts += [" ".join([passage, *rng.choices(vocab, k=20)]) for _ in range(30)]
    return list(enumerate([*texts, None, "", " \n", "one two", "One  TWO", "one three", texts[3].upper()]))


def test_near_duplicates(spark):
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(None, "one two", 1), (*rows[0], 1)], "doc_id long, text string, n int").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    want = slow_kept(rows)
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(want)
    assert kept.where("doc_id is null").count() == 1 and 40 < len(want) < len(rows)
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), "").count() == 0


@pytest.mark.parametrize("keep_one", [near_text.keep_one, simhash.keep_one])
def test_repeated_ids(spark, keep_one):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a, 0), (1, b, 0), (2, a, 0), (3, b + " end", 0), (4, a, 0), (4, a, 0), (5, "own text", 0), (5, "own text", 0), (None, a, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, body int").repartition(3)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(1, a), (1, b), (5, "own text"), (None, a)]))
