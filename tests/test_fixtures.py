"""Small fixtures with known results, and every query against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import geo, json_ops, keyspace, ops, strings, textops, vectors, zsets
from tessera.operators import timeseries as ts
from tessera.operators.aggregate import aggregate
from tessera.operators.search import Index, IndexSpec, fused, highlight
from tessera.plans import catalogue
from tessera.tables import NAMES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float | decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


@pytest.fixture(scope="module")
def books(spark):
    rows = [
        ("doc:1", "redis crash course", "29.99", "tech,databases"),
        ("doc:2", "go programming language", "39.99", "tech,programming"),
        ("doc:3", "modern cooking", "19.99", "food"),
    ]
    table = spark.createDataFrame(rows, "doc_id string, title string, price string, tags string")
    return Index(table, IndexSpec("doc_id", {"title": 2.0}, ("price",), {"tags": ","}))


@pytest.mark.parametrize(
    "text,hits",
    [("*", 3), ("redis", 1), ("@title:redis", 1), ("redis | go", 2), ("@price:[20 40]", 2), ("@tags:{tech}", 2), ("@tags:{tech} -@title:redis", 1), ("prog*", 1), ('"crash course"', 1), ("%rediz%", 1)],
)
def test_search_hits(books, text, hits):
    assert books.search(text).count() == hits


def test_aggregate_sales(spark):
    rows = spark.createDataFrame([("books", "10"), ("books", "20"), ("music", "30")], "category string, price string")
    out = aggregate(rows, "GROUPBY 1 @category REDUCE SUM 1 @price AS total REDUCE COUNT 0 AS n".split())
    assert {(r["category"], r["total"], r["n"]) for r in out.collect()} == {("books", 30.0, 2), ("music", 30.0, 1)}


def test_apply_rules(spark):
    rows = spark.createDataFrame([(10.0, 2.0), (5.0, 0.0)], "a double, b double")
    out = aggregate(rows, ["APPLY", "@a / @b", "AS", "x", "APPLY", "3*-2", "AS", "y"])
    assert [r["x"] for r in out.collect()] == [5.0, 5.0]


def test_fusion(spark):
    leg = lambda *x: spark.createDataFrame(list(x), "doc_id string, score double")
    out = fused(leg(("a", 10.0), ("b", 7.0), ("c", 3.0)), leg(("c", 0.95), ("d", 0.8), ("a", 0.4))).orderBy(F.desc("score"), "doc_id").collect()
    assert len(out) == 4 and out[0]["doc_id"] == "a"
    out = fused(leg(("a", 10.0), ("b", 5.0)), leg(("b", 1.0), ("a", 0.0)), 0.1, 0.9, "minmax").orderBy(F.desc("score")).first()
    assert out["doc_id"] == "b"


def test_fusion_of_flat_legs(spark, tmp_path):
    """A leg whose scores are all equal: nothing by default, what the SQL's division gives in the query."""
    leg = lambda *x: spark.createDataFrame(list(x), "doc_id string, score double")
    out = fused(leg(("a", 2.0), ("b", 2.0)), leg(("b", 1.0), ("a", 0.0)), 0.1, 0.9, "minmax")
    assert {r["doc_id"]: r["score"] for r in out.collect()} == {"a": 0.0, "b": 0.9}
    rows = [(i, "pour " * (i % 5) + "more words", "en", "web", 500) for i in range(70)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.sql(catalogue.ORACLES["hybrid_minmax"]).fetchall()
    got = catalogue.QUERIES["hybrid_minmax"](spark, str(tmp_path)).collect()
    assert sorted((i, str(x)) for i, x in got) == sorted((i, str(x)) for i, x in want)
    assert sum(math.isnan(x) for _, x in got) == 50


def test_highlight(spark):
    row = spark.range(1).select(highlight(F.lit("Fast cars, fastest CARS"), ["cars", "fast"]).alias("h")).first()
    assert row["h"] == "<b>Fast</b> <b>cars</b>, fastest <b>CARS</b>"


def test_series(spark):
    s = spark.createDataFrame([("a", i * 1000, float(i), i) for i in range(1, 11)], "series string, ts long, value double, seq long")
    assert ts.ts_range(s, 3000, 7000).count() == 5
    s = spark.createDataFrame([("a", 1000, 10.0), ("a", 1500, 20.0), ("a", 2000, 30.0), ("a", 2500, 40.0)], "series string, ts long, value double")
    assert sorted(r["value"] for r in ts.aggregated(s, "avg", 1000).collect()) == [15.0, 35.0]
    s = spark.createDataFrame([("a", t, 0.0) for t in (1000, 2000, 4000, 8000)], "series string, ts long, value double")
    assert sorted(r["ts"] for r in ts.retained(s, 5000).collect()) == [4000, 8000]


@pytest.mark.parametrize("policy,value", [("last", 7.0), ("first", 5.0), ("min", 5.0), ("max", 7.0), ("sum", 12.0)])
def test_duplicates(spark, policy, value):
    s = spark.createDataFrame([("a", 1000, 5.0, 1), ("a", 1000, 7.0, 2)], "series string, ts long, value double, seq long")
    assert ts.deduplicated(s, policy).first()["value"] == value


def test_ranked_sets(spark):
    z = spark.createDataFrame([("k", str(i), float(i)) for i in range(10)], "key string, member string, score double")
    assert zsets.zrangebyscore(z, "3", "7").count() == 5
    assert zsets.zrangebyscore(z, "(3", "(7").count() == 3
    assert zsets.zcount(z, "(3", "(7").first()["n"] == 5
    assert zsets.zrangebyscore(z, "-inf", "inf").count() == 10


def test_geo(spark):
    p = spark.createDataFrame([("nyc", -73.9857, 40.7484), ("lon", -0.1276, 51.5074), ("cp", -73.965, 40.782)], "member string, lon double, lat double")
    assert geo.search(p, 40.75, -73.98, 10, "km").count() == 2
    d = p.where("member = 'lon'").select(geo.haversine(F.col("lat"), F.col("lon"), F.lit(40.7484), F.lit(-73.9857)).alias("d")).first()["d"]
    assert 5_250_000 < d < 5_850_000
    assert p.where("member = 'lon'").select(geo.geohash(F.lit(57.64911), F.lit(10.40744)).alias("h")).first()["h"] == "u4pruydqqvj"


@pytest.mark.parametrize(
    "path,n", [("$", 1), ("$.a", 1), ("$.a.b", 1), ("$.a.b[0]", 1), ("$.a.b[*]", 3), ("$.a.*", 2), ("$..b", 1), ("$.items[?(@.qty > 0)]", 2), ("$.xs[?(@.k == 1 || @.k == 3)]", 2), ("$.xs[?(!(@.k == 1))]", 2)]
)
def test_json_paths(spark, path, n):
    doc = '{"a":{"b":[1,2,3],"c":"x"},"d":true,"items":[{"qty":2},{"qty":0},{"qty":5}],"xs":[{"k":1},{"k":2},{"k":3}]}'
    assert spark.range(1).select(json_ops.count(F.lit(doc), path).alias("n")).first()["n"] == n


def test_merge_patch():
    assert json_ops.merge_patch({"a": 1, "b": {"x": 1, "y": 2}}, {"a": 99, "b": {"y": 99, "z": 3}}) == {"a": 99, "b": {"x": 1, "y": 99, "z": 3}}
    assert json_ops.merge_patch({"a": 1}, {"a": None}) == {}


def test_vectors(spark):
    v = spark.createDataFrame([("close", [1.0, 0.0, 0.0]), ("mid", [0.5, 0.5, 0.0]), ("far", [0.0, 0.0, 1.0])], "id string, vec array<double>")
    assert [r["id"] for r in vectors.knn(v, [1, 0, 0], 3, "l2").collect()] == ["close", "mid", "far"]
    likes = spark.createDataFrame([("alice", "go", 1.0), ("bob", "go", 1.0), ("bob", "rust", 1.0), ("carol", "rust", 1.0)], "user string, item string, weight double")
    assert vectors.recommend(likes, "alice", 1).first()["item"] == "rust"


def test_rate_limit(spark):
    c = spark.createDataFrame([(1, i, 0, 1) for i in range(6)], "key long, seq long, ts long, cost long")
    out = ops.rate_limit(c, 1000, 5).orderBy("seq").collect()
    assert [r["allowed"] for r in out] == [True] * 5 + [False] and out[5]["retry_ms"] > 0


def test_text(spark):
    text = "Email me at jane.doe@example.com or call 555-123-4567. SSN 123-45-6789."
    row = spark.range(1).select(textops.redaction_counts(F.lit(text)).alias("c"), textops.redact()(F.lit(text)).alias("r")).first()
    assert (row["c"]["email"], row["c"]["phone_us"], row["c"]["ssn"]) == (1, 1, 1) and "<SSN_1>" in row["r"]["text"]
    row = spark.range(1).select(F.size(textops.chunk_chars(F.lit("a" * 1000), 100)).alias("a"), F.size(textops.chunk_chars(F.lit("a" * 100), 30, 10)).alias("b")).first()
    assert (row["a"], row["b"]) == (10, 5)
    s = spark.createDataFrame([("q", x) for x in ("42", "42", "42", "43", "44")], "query string, sample string")
    out = textops.consensus_exact(s).first()
    assert (out["chosen"], out["confidence"], out["buckets"]) == ("42", 0.6, 3)


def test_strings(spark):
    assert spark.range(1).select(strings.lcs()(F.lit("ohmytext"), F.lit("mynewtext")).alias("l")).first()["l"] == "mytext"
    assert keyspace.crc16("123456789") == 0x31C3 and keyspace.slot("{user}.a") == keyspace.slot("{user}.b")


def test_merges(spark):
    g = spark.createDataFrame([("k", "a", 3), ("k", "a", 1), ("k", "b", 5)], "key string, actor string, n long")
    assert ops.g_counter(g).first()["value"] == 8
    lww = spark.createDataFrame([("k", "a", "off", 100), ("k", "node-b", "on", 200), ("k", "c", "off", 150)], "key string, actor string, value string, ts long")
    assert ops.lww(lww).first()["value"] == "on"
