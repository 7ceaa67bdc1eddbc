"""What keeps other lines out of texts_of()'s shuffles, and how few jobs components take."""

import random

from tessera.graph_components import connected_components
from tessera.llm import line_dedup as L


def test_sieve_keeps_all_named_lines_and_few_others(spark, monkeypatch):
    rng = random.Random(3)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(60_000)] + [0, -1, 1, (1 << 63) - 1, -(1 << 63)]
    every = spark.createDataFrame([(k, str(k)) for k in keys], "k1 long, norm string").repartition(3)
    named = set(keys[:500]) | set(keys[-5:])
    names = spark.createDataFrame([(k,) for k in [*named, *named]], "k1 long")
    for top in (26, 17, 16):
        monkeypatch.setattr(L, "SIEVE", top)
        kept = L.sifted(every, L.sieve(names))
        assert kept.columns == every.columns
        found = [r.k1 for r in kept.collect()]
        assert named <= set(found) and len(found) == len(set(found)) < len(named) + 1200
    assert L.sifted(every, L.sieve(names.limit(0))).isEmpty()


def test_texts_of_other_lines_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"line number {i} of its own {i * 7919}") for i in range(3000)], "doc_id long, text string")
    seen = L.cut(L.lines_of(docs, "doc_id", "text"), "line-seen")
    lines = L.cut(L.signatures(seen), "lines")
    some = lines.orderBy("k1").limit(10).select("k1")
    made = []
    real = L.sifted
    try:
        L.sifted = lambda rows, pages: (made.append(out := real(rows, pages)), out)[1]
        texts = L.texts_of(some, lines, seen)
    finally:
        L.sifted = real
    assert texts.count() == 10 and [x.columns for x in made] == [["doc_id", "k1", "k2", "norm"], lines.columns]


def test_components_count_in_the_write(spark, monkeypatch):
    rng = random.Random(11)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    group = {}
    for a, b in edges:
        both = group.get(a, {a}) | group.get(b, {b})
        for x in both:
            group[x] = both
    want = {x: min(g) for x, g in group.items() if x != min(g)}
    rows = spark.createDataFrame(edges, "a long, b long").repartition(3)
    with monkeypatch.context() as m:
        m.setattr(type(rows), "first", None)
        m.setattr(type(rows), "count", None)
        made = connected_components(rows)
    found = {r.node: r.root for r in made.collect()}
    assert {x: r for x, r in found.items() if x != r} == want
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).isEmpty()
    assert connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()
