"""Sketches rule out pairs before they leave a bucket, and none that is similar."""

import random

from tessera.llm import line_dedup as L


def near_lines(n=160):
    """Lines of one template with words of their own; most pairs are below the threshold, some are not."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(60)]
    out = []
    for _ in range(n):
        own = list(base)
        for k in rng.sample(range(60), rng.randint(1, 6)):
            own[k] = word()
        out.append(" ".join(own))
    return out


def shingles(x):
    return {x[i : i + L.SHINGLE] for i in range(len(x) - L.SHINGLE + 1)}


def test_pairs_of_a_large_bucket(spark):
    lines = near_lines()
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    seen = L.lines_of(docs, "doc_id", "text")
    found = L.signatures(seen)
    names = {r.norm: r.k1 for r in seen.collect()}
    texts = L.texts_of(found.select("k1"), found, seen)
    marks = L.sketches(texts).join(texts.select("k1", "k2", "bins"), ["k1", "k2"]).drop("k2")
    sets = {names[x]: shingles(x) for x in lines}
    counts = {r.k1: r.n for r in marks.collect()}
    assert counts == {k: len(s) for k, s in sets.items()}
    met = L.buckets(L.band_keys(found))
    members = {}
    for r in met.collect():
        members.setdefault(r.key, set()).add(r.k1)
    shared = {(a, b) for m in members.values() for a in m for b in m if a < b}
    near = {(a, b) for a, b in shared if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    none = spark.createDataFrame([], "k1 long, root long")
    made = [tuple(r) for r in L.other_pairs(met, none, marks, [], L.THRESHOLD).collect()]
    assert near <= set(made) <= shared and len(made) == len(set(made))
    assert near and len(made) - len(near) < 0.2 * len(shared - near)
