import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.sources import snapshot
from tessera.streaming import events as st


def stream(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def test_projection(spark, tmp_path):
    rows = [("a", 1.0, at(1)), ("a", 5.0, at(3)), ("b", 2.0, at(2)), ("a", 4.0, at(2))]
    s = stream(spark, tmp_path, rows, "k string, value double, ts timestamp")
    out = {r["k"]: (r["n"], r["total"], r["highest"], r["latest"]) for r in run(st.project(s, "k", "value"), "proj", "complete")}
    assert out == {"a": (3, 10.0, 5.0, 5.0), "b": (1, 2.0, 2.0, 2.0)}


def test_downsample_emits_closed_buckets(spark, tmp_path):
    rows = [("s", at(1), 1.0), ("s", at(2), 3.0), ("s", at(12), 7.0), ("s", at(40), 9.0)]
    s = stream(spark, tmp_path, rows, "series string, ts timestamp, value double")
    out = run(st.downsample(s, "10 minutes", "1 minute"), "down", "append")
    assert sorted((r["mean"], r["n"]) for r in out) == [(2.0, 2), (7.0, 1)]


def test_deduplicate(spark, tmp_path):
    rows = [("b", 1, at(1)), ("b", 1, at(2)), ("b", 2, at(2)), ("c", 1, at(2))]
    s = stream(spark, tmp_path, rows, "bucket string, id long, ts timestamp")
    assert len(run(st.deduplicate(s, "1 hour"), "dedup", "append")) == 3


def test_rate_limit(spark, tmp_path):
    rows = [(1, i, 1000) for i in range(6)] + [(2, 9, 1000)]
    s = stream(spark, tmp_path, rows, "key long, seq long, ts_ms long")
    out = run(st.rate_limited(s, 1000, 5), "rate", "append")
    assert sum(r["allowed"] for r in out if r["key"] == 1) == 5 and sum(r["allowed"] for r in out if r["key"] == 2) == 1


def test_consumer_group(spark, tmp_path):
    rows = [("g", "deliver", "c1", 1), ("g", "deliver", "c1", 2), ("g", "deliver", "c2", 3), ("g", "ack", "c1", 1)]
    s = stream(spark, tmp_path, rows, "grp string, op string, consumer string, id long")
    out = {r["consumer"]: r["pending"] for r in run(st.consumer_group(s), "group", "update")}
    assert out == {"c1": 1, "c2": 1}


def test_snapshot_and_log(spark, tmp_path):
    log = spark.createDataFrame([(1, "a", "x", "set"), (2, "a", "y", "set"), (3, "b", "z", "set"), (4, "b", None, "del")], "seq long, key string, value string, op string")
    snapshot.append(log, str(tmp_path / "log"))
    state = snapshot.rewrite(spark, str(tmp_path / "log"), str(tmp_path / "compact"))
    assert [(r["key"], r["value"]) for r in state.collect()] == [("a", "y")]
    snapshot.save({"string": state}, str(tmp_path / "snap"))
    back = snapshot.load(spark, str(tmp_path / "snap"), ["string"])["string"]
    again = snapshot.restore(snapshot.dump(back), back.schema)
    assert again.exceptAll(back).count() == 0 and back.count() == 1


@pytest.mark.parametrize("pattern,hits", [("order:*", 2), ("o?der:1", 1), ("[xo]rder:[12]", 2), ("none*", 0)])
def test_globs(spark, pattern, hits):
    from tessera.operators.keyspace import keys

    space = spark.createDataFrame([("order:1",), ("order:2",), ("x",)], "key string")
    assert keys(space, pattern).agg(F.count("*")).first()[0] == hits
