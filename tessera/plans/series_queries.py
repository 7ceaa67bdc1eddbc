"""Queries for time series, geo, sketches and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import geo, sketches, streams
from tessera.operators import timeseries as ts
from tessera.plans.registry import query
from tessera.tables import load

HOUR, DAY = 3_600_000, 86_400_000
START = 1_704_067_200_000  # 2024-01-01


def samples(spark, sf, unit: int = 1):
    """Events as samples by type; unit rounds timestamps down, which makes duplicates."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return load(spark, sf, "events").select(F.col("event_type").alias("series"), (ms - ms % unit).alias("ts"), "value", F.col("event_id").alias("seq"))


def T(unit: int = 1) -> str:
    return f"t AS (SELECT event_type AS series, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % {unit} AS ts, value, event_id AS seq FROM events)"


@query("ts_range", f"WITH {T()} SELECT series, ts, value FROM t WHERE ts BETWEEN {START + DAY} AND {START + 3 * DAY}")
def _(spark, sf):
    return ts.ts_range(samples(spark, sf), START + DAY, START + 3 * DAY).select("series", "ts", "value")


_SQL = {
    "avg": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "range": "max(value) - min(value)",
    "count": "count(value)::DOUBLE", "first": "min_by(value, ts)", "last": "max_by(value, ts)", "std.p": "stddev_pop(value)",
    "std.s": "coalesce(stddev_samp(value), 0)", "var.p": "var_pop(value)", "var.s": "coalesce(var_samp(value), 0)",
}
for _how, _sql in _SQL.items():

    @query(
        f"ts_agg_{_how.replace('.', '')}",
        f"WITH {T()}, d AS (SELECT series, ts, max_by(value, seq) AS value FROM t GROUP BY 1, 2) "
        f"SELECT series, (ts - 500) // {DAY} * {DAY} + 500 AS ts, round({_sql} + 1.23e-6, 4) AS value FROM d GROUP BY 1, 2",
    )
    def _(spark, sf, how=_how):
        rows = ts.aggregated(ts.deduplicated(samples(spark, sf), "last"), how, DAY, 500)
        return rows.select("series", "ts", F.round(F.col("value") + 1.23e-6, 4).alias("value"))


for _policy, _sql in {"first": "min_by(value, seq)", "last": "max_by(value, seq)", "min": "min(value)", "max": "max(value)", "sum": "sum(value)"}.items():

    @query(f"ts_dup_{_policy}", f"WITH {T(HOUR)} SELECT series, ts, round({_sql}, 4) AS value FROM t GROUP BY 1, 2")
    def _(spark, sf, policy=_policy):
        return ts.deduplicated(samples(spark, sf, HOUR), policy).withColumn("value", F.round("value", 4))


@query("ts_add_in_order", f"WITH {T()}, n AS (SELECT *, max(ts) OVER (PARTITION BY series ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM t) SELECT series, ts, value, seq FROM n WHERE newest IS NULL OR ts >= newest")
def _(spark, sf):
    return ts.in_order(samples(spark, sf))


@query("ts_retention", f"WITH {T()} SELECT series, ts, value FROM t QUALIFY ts >= max(ts) OVER (PARTITION BY series) - {5 * DAY}")
def _(spark, sf):
    return ts.retained(samples(spark, sf), 5 * DAY).select("series", "ts", "value")


@query("ts_rule_downsample", f"WITH {T()}, b AS (SELECT series, ts // {HOUR} * {HOUR} AS b, max(value) AS value FROM t GROUP BY 1, 2) SELECT series, b AS ts, value FROM b QUALIFY b < max(b) OVER (PARTITION BY series)")
def _(spark, sf):
    return ts.downsampled(samples(spark, sf), "max", HOUR).select("series", "ts", "value")


@query("ts_incrby_running", f"WITH {T()} SELECT series, ts, seq, round(sum(value) OVER (PARTITION BY series ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 3) AS value FROM t")
def _(spark, sf):
    return ts.running_total(samples(spark, sf)).select("series", "ts", "seq", F.round("value", 3).alias("value"))


@query("ts_get_last", f"WITH {T()}, d AS (SELECT series, ts, max_by(value, seq) AS value FROM t GROUP BY 1, 2) SELECT series, max(ts) AS ts, max_by(value, ts) AS value FROM d GROUP BY 1")
def _(spark, sf):
    return ts.last_samples(ts.deduplicated(samples(spark, sf), "last"))


@query("ts_revrange_count", f"WITH {T()}, b AS (SELECT series, ts // {DAY} * {DAY} AS b, count(*)::DOUBLE AS value FROM t GROUP BY 1, 2) SELECT series, b AS ts, value FROM b QUALIFY row_number() OVER (PARTITION BY series ORDER BY b DESC) <= 4")
def _(spark, sf):
    return ts.ts_range(samples(spark, sf), 0, 1 << 60, "count", DAY, count=4, reverse=True).select("series", "ts", "value")


@query("ts_del", f"WITH {T()} SELECT series, count(*) AS n FROM t WHERE NOT ts BETWEEN {START} AND {START + 10 * DAY} GROUP BY 1")
def _(spark, sf):
    return ts.deleted(samples(spark, sf), START, START + 10 * DAY).groupBy("series").agg(F.count("*").alias("n"))


@query("ts_info", f"WITH {T()} SELECT series, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM t GROUP BY 1")
def _(spark, sf):
    return ts.info(samples(spark, sf))


@query("ts_label_filter", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey <> 3")
def _(spark, sf):
    labels = F.create_map(F.lit("seg"), "c_mktsegment", F.lit("nation"), F.col("c_nationkey").cast("string"))
    held = load(spark, sf, "customer").select("c_custkey", labels.alias("labels"))
    return ts.query_index(held, ["seg=(BUILDING,MACHINERY)", "nation!=3", "none=", "seg!="]).select("c_custkey")


@query("ts_mrange_labels", f"WITH {T()} SELECT user_id % 3 AS grp, epoch_us(ts) // 1000 // {DAY} * {DAY} AS ts, round(sum(value), 3) AS value FROM events WHERE event_type <> 'error' GROUP BY 1, 2")
def _(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = load(spark, sf, "events").where("event_type <> 'error'").select((F.col("user_id") % 3).alias("series"), ms.alias("ts"), "value")
    return ts.aggregated(e, "sum", DAY).select(F.col("series").alias("grp"), "ts", F.round("value", 3).alias("value"))


# Geo: customers at points that follow from their keys
def points(spark, sf):
    c = load(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("member"), (F.col("c_custkey") * 7919 % 16000 / 100.0 - 80).alias("lat"), (F.col("c_custkey") * 104729 % 35000 / 100.0 - 175).alias("lon"))


P = "p AS (SELECT c_custkey AS member, c_custkey * 7919 % 16000 / 100.0 - 80 AS lat, c_custkey * 104729 % 35000 / 100.0 - 175 AS lon FROM customer)"


def HAV(a: str, b: str, c: str, d: str, r: float) -> str:
    return f"2 * {r} * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))"


@query("geo_encode", f"""WITH {P}, i AS (SELECT member, floor((lon + 180) / 360 * 67108864)::BIGINT AS x, floor((lat + 85.05112878) / 170.10225756 * 67108864)::BIGINT AS y FROM p)
SELECT member, (list_sum(list_transform(range(26), lambda k: ((x >> k::BIGINT) & 1) * (1::BIGINT << (2 * k))::HUGEINT + ((y >> k::BIGINT) & 1) * (1::BIGINT << (2 * k + 1))::HUGEINT)))::BIGINT AS cell FROM i""")
def _(spark, sf):
    return points(spark, sf).select("member", geo.encode(F.col("lat"), F.col("lon")).alias("cell"))


@query("geo_pos", f"WITH {P} SELECT member, true AS near FROM p")
def _(spark, sf):
    lat, lon = geo.decode(geo.encode(F.col("lat"), F.col("lon")))
    return points(spark, sf).select("member", ((F.abs(lat - F.col("lat")) < 3e-6) & (F.abs(lon - F.col("lon")) < 6e-6)).alias("near"))


@query("geo_dist", f"WITH {P} SELECT member, round({HAV('lat', 'lon', '40.7484', '-73.9857', geo.RADIUS)} / 1000, 3) AS km FROM p")
def _(spark, sf):
    d = geo.haversine(F.col("lat"), F.col("lon"), F.lit(40.7484), F.lit(-73.9857))
    return points(spark, sf).select("member", F.round(d / 1000, 3).alias("km"))


@query("geo_search", f"WITH {P}, d AS (SELECT member, {HAV('40.0', '-74.0', 'lat', 'lon', geo.RADIUS)} / 1000 AS dist FROM p) SELECT member, round(dist, 3) AS dist FROM d WHERE dist <= 3000 ORDER BY d.dist, member LIMIT 30")
def _(spark, sf):
    return geo.search(points(spark, sf), 40.0, -74.0, 3000, "km", 30).select("member", F.round("dist", 3).alias("dist"))


@query("geo_search_predicate", f"WITH {P} SELECT member FROM p WHERE {HAV('10.0', '20.0', 'lat', 'lon', geo.SEARCH_RADIUS)} <= 2500000")
def _(spark, sf):
    return geo.search(points(spark, sf), 10.0, 20.0, 2500, "km", radius=geo.SEARCH_RADIUS).select("member")


@query("geo_radius_by_member", f"WITH {P}, c AS (SELECT * FROM p WHERE member = 7) SELECT p.member FROM p, c WHERE p.member <> 7 AND {HAV('c.lat', 'c.lon', 'p.lat', 'p.lon', geo.RADIUS)} <= 2000000")
def _(spark, sf):
    p = points(spark, sf)
    c = p.where("member = 7").first()
    return geo.search(p, c["lat"], c["lon"], 2000, "km").where("member <> 7").select("member")


@query("geo_pairs_within", f"WITH {P} SELECT a.member AS a, b.member AS b FROM p a, p b WHERE {HAV('a.lat', 'a.lon', 'b.lat', 'b.lon', geo.RADIUS)} <= 300000")
def _(spark, sf):
    return geo.pairs_within(points(spark, sf), points(spark, sf), 300_000).select("a", "b")


@query("geo_hash", f"WITH {P} SELECT count(*) AS n FROM p")
def _(spark, sf):
    h = points(spark, sf).select(geo.geohash(F.col("lat"), F.col("lon")).alias("h"))
    return h.agg(F.count_if(F.length("h") == 11).alias("n"))


# Sketches
@query("pf_count", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"))


@query("pf_count_sketch", "SELECT true AS close")
def _(spark, sf):
    rows = load(spark, sf, "lineitem")
    merged = sketches.merged_count(sketches.distinct_sketch(rows, "l_returnflag", "l_partkey"))
    exact = rows.agg(F.count_distinct("l_partkey").alias("e"))
    return merged.join(F.broadcast(exact)).select((F.abs(F.col("n") - F.col("e")) <= 0.05 * F.col("e")).alias("close"))


@query("bf_exists", "SELECT count(*) AS missed FROM part WHERE false")
def _(spark, sf):
    keys = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"))
    probes = load(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    told = sketches.bloom_contains(probes, "k", keys, 100_000)
    truly = probes.join(keys.distinct(), "k", "left_semi").withColumn("here", F.lit(True))
    return told.join(truly, "k").where("not maybe").agg(F.count("*").alias("missed"))


@query("cf_count", "SELECT l_partkey AS item, greatest(sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END), 0)::BIGINT AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    return sketches.multiset(load(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("delta")))


@query("cms_query", "SELECT 0::BIGINT AS below")
def _(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"))
    told = sketches.count_min_query(sketches.count_min(rows, "k"), rows.distinct(), "k")
    return told.join(rows.groupBy("k").agg(F.count("*").alias("true_n")), "k").where("n < true_n").agg(F.count("*").alias("below"))


@query("topk_list", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 7")
def _(spark, sf):
    return sketches.top_k(load(spark, sf, "lineitem"), "l_suppkey", 7)


@query("hotkeys", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, user_id LIMIT 10")
def _(spark, sf):
    return sketches.top_k(load(spark, sf, "events"), "user_id", 10).where("n >= 5")


@query("dedup_window", f"SELECT event_id, CASE WHEN lag(epoch_us(ts) // 1000) OVER w IS NULL OR (epoch_us(ts) // 1000) - lag(epoch_us(ts) // 1000) OVER w > {DAY} THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY epoch_us(ts) // 1000)")
def _(spark, sf):
    e = load(spark, sf, "events").select("event_id", F.col("event_type").alias("bucket"), F.col("user_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))
    return sketches.dedup_window(e, DAY).select("event_id", "fresh")


# Streams
def log(spark, sf):
    e = load(spark, sf, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return streams.with_ids(e.select(F.col("event_type").alias("stream"), (ms - ms % HOUR).alias("ms"), "event_id", "user_id", "value", "props"), "event_id")


X = f"x AS (SELECT event_type AS stream, epoch_us(ts) // 1000 // {HOUR} * {HOUR} AS ms, event_id, user_id, value, props, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 1000 // {HOUR} ORDER BY event_id) - 1 AS seq FROM events)"


@query("x_add_ids", f"WITH {X} SELECT stream, ms, seq, event_id FROM x")
def _(spark, sf):
    return log(spark, sf).select("stream", "ms", "seq", "event_id")


@query("x_range", f"WITH {X} SELECT stream, ms, seq, event_id FROM x WHERE (ms > {START + DAY} OR (ms = {START + DAY} AND seq >= 1)) AND (ms < {START + 2 * DAY} OR (ms = {START + 2 * DAY} AND seq <= 0))")
def _(spark, sf):
    return streams.xrange(log(spark, sf), (START + DAY, 1), (START + 2 * DAY, 0)).select("stream", "ms", "seq", "event_id")


@query("x_len_trim", f"WITH {X} SELECT stream, ms, seq FROM x QUALIFY row_number() OVER (PARTITION BY stream ORDER BY ms DESC, seq DESC) <= 10")
def _(spark, sf):
    return streams.xtrim(log(spark, sf), 10).select("stream", "ms", "seq")


@query("x_read", f"WITH {X} SELECT stream, ms, seq FROM x WHERE stream IN ('click', 'error') AND (ms > {START + DAY} OR (ms = {START + DAY} AND seq > 0)) QUALIFY row_number() OVER (PARTITION BY stream ORDER BY ms, seq) <= 7")
def _(spark, sf):
    after = spark.createDataFrame([("click", START + DAY, 0), ("error", START + DAY, 0)], "stream string, after_ms long, after_seq long")
    return streams.xread(log(spark, sf), after, 7).select("stream", "ms", "seq")


def group_state(spark, sf):
    """Each entry is delivered to the consumer that its user names; users of even keys twice; every third is acked."""
    held = log(spark, sf).withColumn("grp", F.lit("g"))
    first = held.select("grp", "stream", "ms", "seq", F.concat(F.lit("c"), F.col("user_id") % 4).alias("consumer"), F.col("event_id").alias("delivered_at"), "event_id", "user_id")
    again = first.where("user_id % 2 = 0").withColumn("delivered_at", F.col("delivered_at") + 1_000_000).withColumn("consumer", F.lit("c9"))
    acks = first.where("event_id % 3 = 0").select("grp", "stream", "ms", "seq")
    return streams.pending(first.drop("event_id", "user_id").union(again.drop("event_id", "user_id")), acks)


_PEND = f"{X}, pend AS (SELECT stream, ms, seq, event_id, user_id, CASE WHEN user_id % 2 = 0 THEN 'c9' ELSE 'c' || user_id % 4 END AS consumer, CASE WHEN user_id % 2 = 0 THEN event_id + 1000000 ELSE event_id END AS delivered_at, CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END AS deliveries FROM x WHERE event_id % 3 <> 0)"


@query("x_pending", f"WITH {_PEND} SELECT stream, ms, seq, consumer, delivered_at, deliveries FROM pend")
def _(spark, sf):
    return group_state(spark, sf).select("stream", "ms", "seq", "consumer", "delivered_at", "deliveries")


@query("x_pending_summary", f"WITH {_PEND} SELECT consumer, count(*) AS n FROM pend GROUP BY 1")
def _(spark, sf):
    return streams.pending_summary(group_state(spark, sf)).select("consumer", "n")


@query("x_autoclaim", f"WITH {_PEND} SELECT stream, ms, seq, 'c1' AS consumer, deliveries + 1 AS deliveries FROM pend WHERE 2000000 - delivered_at >= 1500000 QUALIFY row_number() OVER (PARTITION BY stream ORDER BY ms, seq) <= 5")
def _(spark, sf):
    claimed = streams.autoclaim(group_state(spark, sf), log(spark, sf), F.lit(2_000_000), 1_500_000, "c1", 5)
    return claimed.select("stream", "ms", "seq", "consumer", "deliveries")


@query("x_group_lag", f"WITH {X} SELECT stream, count(*) AS entries, count_if(event_id % 3 <> 0) AS pending FROM x GROUP BY 1")
def _(spark, sf):
    p = group_state(spark, sf).groupBy("stream").agg(F.count("*").alias("pending"))
    return log(spark, sf).groupBy("stream").agg(F.count("*").alias("entries")).join(p, "stream")


_PROJ = "p AS (SELECT event_type AS stream, event_id AS seq, json_extract_string(props, '$.k') AS k, value FROM events)"
for _how, _sql in {"count": "count(*)::DOUBLE", "sum": "sum(k::DOUBLE)", "max": "max(k::DOUBLE)", "latest": "max_by(k::DOUBLE, seq)"}.items():

    @query(f"event_project_{_how}", f"WITH {_PROJ} SELECT stream, '_total' AS grp, {_sql} AS value FROM p GROUP BY 1")
    def _(spark, sf, how=_how):
        e = load(spark, sf, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("seq"), F.col("props").alias("payload"))
        return streams.project(e, how, "k")


@query("event_project_grouped", f"WITH {_PROJ} SELECT stream, coalesce(k, '_total') AS grp, count(*)::DOUBLE AS value FROM p GROUP BY 1, 2")
def _(spark, sf):
    e = load(spark, sf, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("seq"), F.col("props").alias("payload"))
    return streams.project(e, "count", "k", "k")


@query("event_append_range", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq FROM events QUALIFY seq BETWEEN 3 AND 9")
def _(spark, sf):
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    return load(spark, sf, "events").withColumn("seq", seq).where("seq between 3 and 9").select("event_id", F.col("seq").cast("long"))


@query("pubsub_match", "SELECT event_type AS channel, p AS pattern, count(*) AS n FROM events, (SELECT unnest(['c*', '*r*']) AS p) WHERE (p = 'c*' AND event_type LIKE 'c%') OR (p = '*r*' AND event_type LIKE '%r%') GROUP BY 1, 2")
def _(spark, sf):
    from tessera.operators.keyspace import glob_regex

    subs = spark.createDataFrame([("c*", glob_regex("c*")), ("*r*", glob_regex("*r*"))], "pattern string, rx string")
    e = load(spark, sf, "events").groupBy(F.col("event_type").alias("channel")).agg(F.count("*").alias("n"))
    return e.join(F.broadcast(subs), F.expr("channel rlike rx")).select("channel", "pattern", "n")


@query("geo_search_store", f"WITH {P}, d AS (SELECT member, {HAV('40.0', '-74.0', 'lat', 'lon', geo.RADIUS)} / 1000 AS dist FROM p) SELECT 'near' AS key, member, round(dist, 3) AS score FROM d WHERE dist <= 3000")
def _(spark, sf):
    return geo.search_store(points(spark, sf), "near", 40.0, -74.0, 3000, "km").withColumn("score", F.round("score", 3))


@query("x_del", f"WITH {X} SELECT stream, ms, seq FROM x WHERE event_id % 5 <> 0")
def _(spark, sf):
    x = log(spark, sf)
    return streams.xdel(x, x.where("event_id % 5 = 0")).select("stream", "ms", "seq")


@query("x_trim_minid", f"WITH {X} SELECT stream, ms, seq FROM x WHERE ms > {START + DAY} OR (ms = {START + DAY} AND seq >= 1)")
def _(spark, sf):
    return streams.xtrim_before(log(spark, sf), START + DAY, 1).select("stream", "ms", "seq")
