"""What op8 spares: dictionaries of hashes, sorting of lines that stand once, and texts of small buckets in the large ones' step."""

import glob
import random

import pyarrow.parquet as pq

from tessera.llm import line_dedup as L


def test_tables_have_no_dictionaries(spark):
    table = L.cut(spark.createDataFrame([(k % 7, f"line {k % 7}") for k in range(200)], "k1 long, norm string"), "test-lines")
    files = glob.glob(f"{table._tessera_path.removeprefix('file://')}/*.parquet")
    columns = [g.column(c) for f in files for m in [pq.ParquetFile(f).metadata] for r in range(m.num_row_groups) for g in [m.row_group(r)] for c in range(2)]
    assert columns and not any(c.has_dictionary_page for c in columns) and table.count() == 200


def test_one_text_a_line(spark, monkeypatch):
    texts = ["a line that stands twice\nonce here\na line that stands twice", "a line that stands twice\nonce there", "Once here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    seen = L.cut(L.lines_of(docs, "doc_id", "text"), "line-seen")
    lines, plans, real = L.cut(L.signatures(seen), "lines"), {}, L.cut
    monkeypatch.setattr(L, "cut", lambda df, tag: (plans.update({tag: df._jdf.queryExecution().optimizedPlan().toString()}), real(df, tag))[1])
    found = L.texts_of(lines.select("k1"), lines, seen).collect()
    assert sorted(r.b.decode("utf-16-be") for r in found) == ["a line that stands twice", "once here", "once there"]
    # a semi-join would be done before the sieve, over all lines
    assert "LeftSemi" not in plans["line-names"]


def test_union_tells_what_is_common(spark):
    rng = random.Random(4)
    line = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 60)))
    pairs = [(a, a[: rng.randint(1, len(a))] + line()[: rng.randint(0, 6)]) for a in (line() for _ in range(200))] + [("漢字 é 😀" * 3, "漢字 é 😀" * 2)]
    units = lambda x: x.encode("utf-16-be")
    sets = lambda x: {units(x)[2 * i : 2 * (i + L.SHINGLE)] for i in range(max(1, len(units(x)) // 2 - L.SHINGLE + 1))}
    rows = [(i, units(a), units(b), len(sets(a)), len(sets(b))) for i, (a, b) in enumerate(pairs)]
    table = spark.createDataFrame(rows, "i long, a binary, b binary, n_a long, n_b long")
    want = {i for i, (a, b) in enumerate(pairs) if 5 * len(sets(a) & sets(b)) >= 4 * len(sets(a) | sets(b))}
    assert {r.i for r in table.where(L.similar("a", "b", "n_a", "n_b", L.THRESHOLD)).collect()} == want and 0 < len(want) < len(pairs)


def test_large_buckets_take_their_own_lines(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(60)], []
    for _ in range(30):
        own = list(base)
        for k in rng.sample(range(60), rng.randint(1, 6)):
            own[k] = word()
        rows.append(" ".join(own))
    for _ in range(40):
        own = [word() for _ in range(40)]
        rows += [" ".join(own), " ".join([*own[:20], word(), *own[21:]])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(L, "SMALL", 3)
    made, real = [], L.sifted
    monkeypatch.setattr(L, "sifted", lambda r, pages: (made.append((r, out := real(r, pages))), out)[1])
    sizes, verified = [], L.verified

    def counted(pairs, texts, marks, *more, **named):
        sizes.append((texts.count(), marks.count()))
        return verified(pairs, texts, marks, *more, **named)

    monkeypatch.setattr(L, "verified", counted)
    L.deduplicated(docs).collect()
    assert sizes[0][0] == sizes[0][1] > 60
    assert len(sizes) > 1 and all(0 < n < sizes[0][0] - 30 and m == n for n, m in sizes[1:])
