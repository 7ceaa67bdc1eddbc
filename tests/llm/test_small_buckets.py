"""Small buckets are settled at once by all their pairs; lines lose their outer white space by either way."""

from pyspark.sql import functions as F

from tessera.llm import line_dedup as L


def test_all_pairs_of_small_buckets(spark):
    rows = [(n, (7 * k) % n, 100 * n + k, 100 * n, n) for n in (2, 3, 6, L.SMALL, L.SMALL + 3) for k in range(n)]
    met = spark.createDataFrame(rows, "key long, o int, k1 long, first long, size long").repartition(3)
    made = [tuple(r) for r in L.bucket_pairs(met, L.SMALL - 1).collect()]
    assert len(made) == len(set(made))
    for n in (2, 3, 6, L.SMALL):
        own = {(a - 100 * n, b - 100 * n) for a, b in made if a // 100 == n}
        assert own == {(a, b) for b in range(n) for a in range(b)}
    large = {p for p in made if p[0] // 100 == L.SMALL + 3}
    assert large == {tuple(r) for r in L.bucket_pairs(met).collect() if r.a // 100 == L.SMALL + 3}
    assert len(large) <= 2 * (L.SMALL + 3)


def test_small_buckets_need_no_rounds(spark, monkeypatch):
    line = "the quick brown fox jumps over the lazy dog near the river bank at {} o'clock sharp"
    docs = spark.createDataFrame([(i, line.format(i)) for i in range(4)], "doc_id long, text string")
    monkeypatch.setattr(L, "mixed_pairs", None)
    monkeypatch.setattr(L, "other_pairs", None)
    assert sorted(r.lines_gone for r in L.deduplicated(docs).collect()) == [0, 1, 1, 1]


def test_trimmed_equals_btrim(spark):
    ends = ["", " ", "\t", "\r", "\x0b", "\x0c", " \t\r", " ", "　", "\x00"]
    rows = [(a + x + b,) for a in ends for b in ends for x in ("", "x", "a b", "é", "漢字", "😀 x")]
    lines = spark.createDataFrame([*rows, (None,)], "line string")
    found = lines.select(L.trimmed("line").alias("x"), F.btrim("line", F.lit(L.BLANK)).alias("y"))
    assert found.where("not x <=> y").isEmpty()
