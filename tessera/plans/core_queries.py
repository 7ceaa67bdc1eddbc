"""Queries for keys, strings, lists, hashes, sets and ranked sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import hashes, keyspace, lists, sets, strings, zsets
from tessera.plans.registry import query
from tessera.tables import load

NOW_MS = 1_704_500_000_000  # the moment that expiry queries ask about


# Adapters: the test tables as keyspaces, and the same in SQL.
def kv(spark, sf):
    """Orders as string keys that expire 90 days after their date; every fifth never does."""
    o = load(spark, sf, "orders")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return o.select(
        F.concat(F.lit("order:"), "o_orderkey").alias("key"),
        F.col("o_orderpriority").alias("value"),
        F.when(F.col("o_orderkey") % 5 != 0, ms + F.lit(90 * 86_400_000).cast("long")).alias("expire_ms"),
        "o_orderkey",
    )


KV = """kv AS (SELECT 'order:' || o_orderkey AS key, o_orderpriority AS value, o_orderkey,
  CASE WHEN o_orderkey % 5 <> 0 THEN (epoch_us(o_orderdate) // 1000) + 7776000000 END AS expire_ms FROM orders)"""


def segments(spark, sf):
    """Customers as ranked sets: segment, name, balance."""
    return load(spark, sf, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))


Z = "z AS (SELECT c_mktsegment AS key, c_name AS member, c_acctbal AS score FROM customer)"


def flag_parts(spark, sf):
    """Line items as sets of parts by return flag."""
    return load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_partkey").alias("member")).distinct()


S = "s AS (SELECT DISTINCT l_returnflag AS key, l_partkey AS member FROM lineitem)"


def customer_lists(spark, sf):
    """Orders as lists of order sizes (thousands) by customer, in order of key."""
    o = load(spark, sf, "orders").select("o_custkey", F.struct("o_orderkey", F.floor(F.col("o_totalprice") / 50000).cast("long").alias("v")).alias("x"))
    return o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("l"))


L = "l AS (SELECT o_custkey, list(floor(o_totalprice / 50000)::BIGINT ORDER BY o_orderkey) AS l FROM orders GROUP BY 1)"


def user_hashes(spark, sf):
    """Events as hashes: user, counts by type."""
    e = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return e.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))


H = """e AS (SELECT user_id, event_type AS k, count(*) AS n FROM events GROUP BY 1, 2),
  h AS (SELECT user_id, map(list(k ORDER BY k), list(n ORDER BY k)) AS m FROM e GROUP BY 1)"""


# Keys
@query("get", f"WITH {KV} SELECT value FROM kv WHERE key = 'order:7'")
def _(spark, sf):
    return kv(spark, sf).where("key = 'order:7'").select("value")


@query("mget", f"WITH {KV}, w AS (SELECT unnest([1, 2, 3, 4]) AS pos, unnest(['order:5', 'order:x', 'order:1', 'order:5']) AS key) SELECT pos, key, value FROM w LEFT JOIN kv USING (key)")
def _(spark, sf):
    wanted = spark.createDataFrame([(1, "order:5"), (2, "order:x"), (3, "order:1"), (4, "order:5")], "pos int, key string")
    return keyspace.mget(kv(spark, sf), wanted)


@query("keys_glob", f"WITH {KV} SELECT key FROM kv WHERE regexp_matches(key, '^order:[13].*5.$')")
def _(spark, sf):
    return keyspace.keys(kv(spark, sf), "order:[13]*5?")


@query("scan_page", f"WITH {KV}, p AS (SELECT key FROM kv ORDER BY key LIMIT 50 OFFSET 20) SELECT key FROM p WHERE key LIKE '%1'")
def _(spark, sf):
    return keyspace.scan(kv(spark, sf), 20, 50, "*1")


@query("random_key", f"WITH {KV} SELECT count(*) > 0 AS found FROM kv")
def _(spark, sf):
    one = kv(spark, sf).orderBy(F.xxhash64("key", F.lit(3)), "key").limit(1)
    return one.agg((F.count("*") > 0).alias("found"))


@query("dbsize", f"WITH {KV} SELECT count(*) AS n FROM kv")
def _(spark, sf):
    return kv(spark, sf).agg(F.count("*").alias("n"))


@query("type_counts", f"WITH {KV}, {Z}, {S} SELECT 'string' AS type, count(*) AS n FROM kv UNION ALL SELECT 'zset', count(DISTINCT key) FROM z UNION ALL SELECT 'set', count(DISTINCT key) FROM s")
def _(spark, sf):
    typed = lambda df, t: df.select("key").distinct().select(F.lit(t).alias("type"))
    union = typed(kv(spark, sf), "string").union(typed(segments(spark, sf), "zset")).union(typed(flag_parts(spark, sf), "set"))
    return union.groupBy("type").agg(F.count("*").alias("n"))


@query("exists_count", f"WITH {KV}, w AS (SELECT unnest(['order:5', 'order:5', 'order:x', 'order:1']) AS key) SELECT count(*) AS n FROM w WHERE key IN (SELECT key FROM kv)")
def _(spark, sf):
    return keyspace.exists(kv(spark, sf), spark.createDataFrame([(k,) for k in ("order:5", "order:5", "order:x", "order:1")], "key string"))


@query("del_keys", f"WITH {KV} SELECT count(*) AS n FROM kv WHERE key NOT IN ('order:5', 'order:7')")
def _(spark, sf):
    gone = spark.createDataFrame([("order:5",), ("order:7",), ("none",)], "key string")
    return keyspace.delete(kv(spark, sf), gone).agg(F.count("*").alias("n"))


@query("delex", f"WITH {KV} SELECT key, CASE WHEN value LIKE '1%' THEN 1 ELSE 0 END AS status FROM kv")
def _(spark, sf):
    return kv(spark, sf).select("key", F.when(F.col("value").startswith("1"), 1).otherwise(0).alias("status"))


@query("ttl_live", f"WITH {KV} SELECT key, CASE WHEN expire_ms IS NULL THEN -1 ELSE expire_ms - {NOW_MS} END AS pttl FROM kv WHERE expire_ms IS NULL OR expire_ms > {NOW_MS}")
def _(spark, sf):
    now = F.lit(NOW_MS)
    return keyspace.live(kv(spark, sf), now).select("key", keyspace.pttl(F.col("expire_ms"), now).alias("pttl"))


@query("expire_persist", f"WITH {KV} SELECT key, CASE WHEN o_orderkey % 3 = 0 THEN {NOW_MS} WHEN o_orderkey % 3 = 1 THEN NULL ELSE expire_ms END AS expire_ms FROM kv")
def _(spark, sf):
    k = F.col("o_orderkey") % 3
    return keyspace.persist(keyspace.expire(kv(spark, sf), k == 0, F.lit(NOW_MS)), k == 1).select("key", "expire_ms")


@query("rename", f"WITH {KV} SELECT CASE WHEN key = 'order:1' THEN 'order:2' ELSE key END AS key, value FROM kv WHERE key <> 'order:2'")
def _(spark, sf):
    return keyspace.rename(kv(spark, sf), "order:1", "order:2").select("key", "value")


@query("renamenx", f"WITH {KV} SELECT key, count(*) AS n FROM kv GROUP BY 1")
def _(spark, sf):
    return keyspace.rename(kv(spark, sf), "order:1", "order:2", only_new=True).groupBy("key").agg(F.count("*").alias("n"))


@query("copy_key", f"WITH {KV} SELECT key, value FROM kv UNION ALL SELECT 'twin', value FROM kv WHERE key = 'order:1'")
def _(spark, sf):
    return keyspace.copy(kv(spark, sf), "order:1", "twin").select("key", "value")


@query("log_replay", "SELECT o_custkey AS key, max_by(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY 1 HAVING max_by(o_orderstatus, o_orderkey) <> 'P'")
def _(spark, sf):
    op = F.when(F.col("o_orderstatus") == "P", "del").otherwise("set")
    log = load(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("value"), op.alias("op"))
    return keyspace.replay(log)


@query("object_encoding", "SELECT p_partkey, CASE WHEN strlen(p_name || p_type || p_brand || p_name) <= 44 THEN 'embstr' ELSE 'raw' END AS name_encoding, 'int' AS key_encoding FROM part")
def _(spark, sf):
    long_name = F.concat("p_name", "p_type", "p_brand", "p_name")
    return load(spark, sf, "part").select("p_partkey", keyspace.encoding(long_name).alias("name_encoding"), keyspace.encoding(F.col("p_partkey").cast("string")).alias("key_encoding"))


@query("digest_string", "SELECT p_partkey, sha1('S:' || p_name) AS digest FROM part")
def _(spark, sf):
    return load(spark, sf, "part").select("p_partkey", keyspace.digest_string(F.col("p_name")).alias("digest"))


@query("digest_set", "SELECT n_regionkey, sha1('X:' || string_agg(n_name || chr(0), '' ORDER BY n_name)) AS digest FROM nation GROUP BY 1")
def _(spark, sf):
    return load(spark, sf, "nation").groupBy("n_regionkey").agg(keyspace.digest_members("X:", F.collect_set("n_name")).alias("digest"))


@query("sort_by_get", "SELECT o_orderkey AS item, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey QUALIFY row_number() OVER (ORDER BY coalesce(c_acctbal, 0) DESC, o_orderkey) <= 25")
def _(spark, sf):
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"], "left").select(o["o_orderkey"].alias("item"), "c_name", F.coalesce("c_acctbal", F.lit(0.0)).alias("w"))
    return joined.orderBy(F.desc("w"), "item").limit(25).select("item", "c_name")


@query("sort_numeric", "SELECT p_partkey AS pos, regexp_extract(p_name, '^[^ ]+') AS item FROM part QUALIFY row_number() OVER (ORDER BY 0, p_partkey) <= 30")
def _(spark, sf):
    items = load(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.regexp_extract("p_name", "^[^ ]+", 0).alias("item"))
    return keyspace.sort_by(items).limit(30).select("pos", "item")


@query("evict_victims", "SELECT p_partkey AS key, p_size * 0.40 + 0.35 / (1 + p_retailprice / 3600.0) - strlen(p_name) / 1024.0 * 0.25 AS score FROM part ORDER BY score, key LIMIT 20")
def _(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_size", "p_retailprice", "p_name")
    score = keyspace.eviction_score(F.col("p_size"), F.col("p_retailprice"), F.octet_length("p_name"))
    return keyspace.victims(p, score, 20).select("key", "score")


@query("slot_stats")
def _(spark, sf):
    return keyspace.slot_stats(kv(spark, sf), 10)


@query("flushall", "SELECT 0 AS n")
def _(spark, sf):
    return kv(spark, sf).where(F.lit(False)).agg(F.count("*").alias("n"))


# Strings and bits
@query("str_getrange", "SELECT p_partkey, substr(p_name, 3, 4) AS a, right(p_name, 3) AS b FROM part")
def _(spark, sf):
    p = load(spark, sf, "part")
    return p.select("p_partkey", strings.getrange(F.col("p_name"), 2, 5).alias("a"), strings.getrange(F.col("p_name"), -3, -1).alias("b"))


@query("str_setrange", "SELECT p_partkey, left(p_name, 2) || 'XYZ' || substr(p_name, 6) AS v FROM part")
def _(spark, sf):
    return load(spark, sf, "part").select("p_partkey", strings.setrange(F.col("p_name"), 2, "XYZ").alias("v"))


@query("str_append_len", "SELECT p_partkey, p_name || '/' || p_brand AS v, strlen(p_name || '/' || p_brand)::BIGINT AS n FROM part")
def _(spark, sf):
    v = strings.append(F.col("p_name"), F.concat(F.lit("/"), "p_brand"))
    return load(spark, sf, "part").select("p_partkey", v.alias("v"), strings.strlen(v).alias("n"))


@query("incr_by_log", "SELECT l_partkey AS key, sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)::BIGINT AS value FROM lineitem GROUP BY 1")
def _(spark, sf):
    delta = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return load(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.sum(delta).alias("value"))


@query("incr_by_float", "SELECT l_partkey AS key, round(sum(l_discount), 4) AS value FROM lineitem GROUP BY 1")
def _(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.round(F.sum("l_discount"), 4).alias("value"))


@query("setnx_first", "SELECT o_custkey AS key, min_by(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY 1")
def _(spark, sf):
    return load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("value"))


@query("mset_last", "SELECT o_custkey AS key, max_by(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY 1")
def _(spark, sf):
    return load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("value"))


@query("lcs")
def _(spark, sf):
    p = load(spark, sf, "part")
    return p.select("p_partkey", strings.lcs()(F.col("p_name"), F.col("p_type")).alias("lcs"))


@query("bit_get", "SELECT p_partkey, (ascii(substr(p_name, 1, 1)) >> 5) & 1 AS b2, (ascii(substr(p_name, 2, 1)) >> 7) & 1 AS b8 FROM part")
def _(spark, sf):
    n = F.col("p_name")
    return load(spark, sf, "part").select("p_partkey", strings.getbit(n, 2).alias("b2"), strings.getbit(n, 8).alias("b8"))


@query("bit_count", "SELECT p_partkey, length(replace(bin(substr(p_brand, 1, 4)), '0', '')) AS n FROM part")
def _(spark, sf):
    return load(spark, sf, "part").select("p_partkey", strings.bitcount(F.col("p_brand"), 0, 3).cast("long").alias("n"))


@query("bit_pos", "SELECT p_partkey, strpos(bin(p_brand), '1') - 1 AS one FROM part")
def _(spark, sf):
    return load(spark, sf, "part").select("p_partkey", strings.bitpos(F.col("p_brand"), 1).alias("one"))


@query("bitmap_users", "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def _(spark, sf):
    e = load(spark, sf, "events").groupBy("event_type", F.bitmap_bucket_number("user_id").alias("b")).agg(
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("user_id"))).alias("n")
    )
    return e.groupBy("event_type").agg(F.sum("n").alias("n"))


@query("bitop_and_or_xor", """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
SELECT 'and' AS op, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'or', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'xor', count(*) FROM ((SELECT * FROM a UNION SELECT * FROM b) EXCEPT (SELECT * FROM a INTERSECT SELECT * FROM b))""")
def _(spark, sf):
    e = load(spark, sf, "events").where("event_type in ('click', 'error')")
    has = lambda t: F.bool_or(F.col("event_type") == t)
    flags = e.groupBy("user_id").agg(has("click").alias("a"), has("error").alias("b"))
    count = flags.agg(F.count_if(F.col("a") & F.col("b")).alias("and"), F.count_if(F.col("a") | F.col("b")).alias("or"), F.count_if(F.col("a") != F.col("b")).alias("xor"))
    return count.select(F.expr("stack(3, 'and', `and`, 'or', `or`, 'xor', `xor`) as (op, n)"))


@query("bitfield", "SELECT o_orderkey, ((o_custkey * 37 + 128) % 256 + 256) % 256 - 128 AS wrapped, least(o_custkey, 127) AS saturated, (o_orderkey >> 2) & 7 AS field FROM orders")
def _(spark, sf):
    o = load(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        strings.field_wrap(F.col("o_custkey") * 37, 8).alias("wrapped"),
        strings.field_saturate(F.col("o_custkey"), 8).alias("saturated"),
        strings.field_get(F.col("o_orderkey"), 2, 3).alias("field"),
    )


# Lists
@query("l_push_len", f"WITH {L} SELECT o_custkey, [-1, -2] || l || [-3] AS v, len(l) + 3 AS n FROM l")
def _(spark, sf):
    v = lists.rpush(lists.lpush(F.col("l"), F.lit(-2).cast("long"), F.lit(-1).cast("long")), F.lit(-3).cast("long"))
    return customer_lists(spark, sf).select("o_custkey", v.alias("v"), F.size(v).cast("long").alias("n"))


@query("l_pop", f"WITH {L} SELECT o_custkey, l[1] AS head, l[-1] AS tail, l[2:] AS rest FROM l")
def _(spark, sf):
    a = F.col("l")
    return customer_lists(spark, sf).select("o_custkey", lists.lindex(a, 0).alias("head"), lists.lindex(a, -1).alias("tail"), lists.lrange(a, 1, -1).alias("rest"))


@query("l_range_trim", f"WITH {L} SELECT o_custkey, l[2:4] AS a, l[-3:] AS b FROM l")
def _(spark, sf):
    return customer_lists(spark, sf).select("o_custkey", lists.lrange(F.col("l"), 1, 3).alias("a"), lists.lrange(F.col("l"), -3, -1).alias("b"))


@query("l_set", f"WITH {L} SELECT o_custkey, CASE WHEN len(l) >= 2 THEN [l[1]] || [99] || l[3:] ELSE l END AS v FROM l")
def _(spark, sf):
    return customer_lists(spark, sf).select("o_custkey", lists.lset(F.col("l"), 1, F.lit(99).cast("long")).alias("v"))


@query("l_rem", f"WITH {L} SELECT o_custkey, list_filter(l, lambda x: x <> 1) AS every, l[:coalesce(list_position(l, 2), 99999) - 1] || l[coalesce(list_position(l, 2), 99999) + 1:] AS first FROM l")
def _(spark, sf):
    one, two = F.lit(1).cast("long"), F.lit(2).cast("long")
    return customer_lists(spark, sf).select("o_custkey", lists.lrem(F.col("l"), 0, one).alias("every"), lists.lrem(F.col("l"), 1, two).alias("first"))


@query("l_insert", f"WITH {L} SELECT o_custkey, l[:list_position(l, 2) - 1] || [77] || l[list_position(l, 2):] AS v FROM l WHERE list_contains(l, 2)")
def _(spark, sf):
    v = lists.linsert(F.col("l"), F.lit(2).cast("long"), F.lit(77).cast("long"))
    return customer_lists(spark, sf).select("o_custkey", v.alias("v")).where("v is not null")


@query("l_pos", f"WITH {L} SELECT o_custkey, list_filter(list_transform(l, lambda x, i: CASE WHEN x = 2 THEN i - 1 END), lambda x: x IS NOT NULL) AS p FROM l")
def _(spark, sf):
    return customer_lists(spark, sf).select("o_custkey", F.transform(lists.lpos(F.col("l"), F.lit(2).cast("long"), count=0), lambda x: x.cast("long")).alias("p"))


@query("l_move_rotate", f"WITH {L} SELECT o_custkey, CASE WHEN len(l) > 1 THEN [l[-1]] || l[:len(l) - 1] ELSE l END AS v FROM l")
def _(spark, sf):
    return customer_lists(spark, sf).select("o_custkey", lists.rotate(F.col("l")).alias("v"))


@query("lmpop_first_non_empty", f"WITH {L} SELECT min(o_custkey) AS key, min_by(l[:2], o_custkey) AS popped FROM l WHERE len(l) > 0 AND o_custkey > 3")
def _(spark, sf):
    some = customer_lists(spark, sf).where("o_custkey > 3").where(F.size("l") > 0)
    return some.agg(F.min("o_custkey").alias("key"), F.min_by(lists.lrange(F.col("l"), 0, 1), "o_custkey").alias("popped"))


# Hashes
@query("h_get", f"WITH {H} SELECT user_id, m['click'] AS click, m['none'] AS none FROM h")
def _(spark, sf):
    m = F.col("m")
    return user_hashes(spark, sf).select("user_id", hashes.hget(m, "click").alias("click"), hashes.hget(m, "none").alias("none"))


@query("h_keys_vals_len", f"WITH {H} SELECT user_id, map_keys(m) AS k, map_values(m) AS v, cardinality(m)::BIGINT AS n FROM h")
def _(spark, sf):
    return user_hashes(spark, sf).select("user_id", F.map_keys("m").alias("k"), F.map_values("m").alias("v"), F.size("m").cast("long").alias("n"))


@query("h_del_exists", f"WITH {H} SELECT user_id, list_filter(map_keys(m), lambda x: x NOT IN ('click', 'view')) AS k, list_contains(map_keys(m), 'error') AS has FROM h")
def _(spark, sf):
    m = F.col("m")
    return user_hashes(spark, sf).select("user_id", F.map_keys(hashes.hdel(m, ["click", "view"])).alias("k"), F.map_contains_key(m, F.lit("error")).alias("has"))


@query("h_set_setnx", f"WITH {H} SELECT user_id, -1 AS a, coalesce(m['error'], 0) AS b FROM h")
def _(spark, sf):
    m = F.col("m")
    a = hashes.hset(m, F.lit("click"), F.lit(-1).cast("long"))
    b = hashes.hsetnx(m, F.lit("error"), F.lit(0).cast("long"))
    return user_hashes(spark, sf).select("user_id", F.element_at(a, "click").cast("int").alias("a"), F.element_at(b, "error").alias("b"))


@query("h_incrby", "SELECT user_id AS key, event_type AS field, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def _(spark, sf):
    log = load(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.col("value").alias("delta"))
    return hashes.hincrby(log).withColumn("value", F.round("value", 4))


@query("h_expire_gates", f"WITH {KV} SELECT key, CASE WHEN expire_ms IS NULL OR {NOW_MS} > expire_ms THEN 1 ELSE 0 END AS gt, CASE WHEN expire_ms IS NULL THEN 1 ELSE 0 END AS nx FROM kv")
def _(spark, sf):
    old, new = F.col("expire_ms"), F.lit(NOW_MS)
    return kv(spark, sf).select("key", hashes.hexpire_status(old, new, "GT").alias("gt"), hashes.hexpire_status(old, new, "NX").alias("nx"))


@query("h_setex_fnx", """WITH f AS (SELECT user_id AS key, event_type AS field, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY 1, 2),
w AS (SELECT DISTINCT user_id AS key, unnest(['signup', 'error']) AS field FROM events), g AS (SELECT key FROM w LEFT JOIN f USING (key, field) GROUP BY key HAVING bool_and(n IS NULL))
SELECT key, field, n FROM f UNION ALL SELECT key, field, 0 FROM w WHERE key IN (SELECT key FROM g)""")
def _(spark, sf):
    e = load(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"))
    held = e.where("field <> 'signup'").groupBy("key", "field").agg(F.count("*").alias("n"))
    new = e.select("key").distinct().select("key", F.explode(F.array(F.lit("signup"), F.lit("error"))).alias("field"), F.lit(0).cast("long").alias("n"))
    return hashes.hsetex(held, new, "FNX")


@query("h_randfield", f"WITH {H} SELECT user_id, 1 AS n FROM h")
def _(spark, sf):
    picked = F.array_min(F.transform(F.map_keys("m"), lambda k: F.struct(F.xxhash64(k, F.lit(5)).alias("h"), k.alias("k"))))["k"]
    return user_hashes(spark, sf).select("user_id", F.map_contains_key("m", picked).cast("int").alias("n"))


# Sets
@query("s_inter", f"WITH {S} SELECT member FROM s WHERE key = 'A' INTERSECT SELECT member FROM s WHERE key = 'R'")
def _(spark, sf):
    return sets.sinter(flag_parts(spark, sf), ["A", "R"])


@query("s_union", f"WITH {S} SELECT DISTINCT member FROM s WHERE key IN ('A', 'R')")
def _(spark, sf):
    return sets.sunion(flag_parts(spark, sf), ["A", "R"])


@query("s_diff", "SELECT o_custkey AS member FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(spark, sf):
    buyers = load(spark, sf, "orders").select(F.col("o_orderstatus").alias("key"), F.col("o_custkey").alias("member")).distinct()
    return sets.sdiff(buyers, "F", ["P"])


@query("s_intercard", f"WITH {S} SELECT least(count(*), 50) AS n FROM (SELECT member FROM s WHERE key = 'A' INTERSECT SELECT member FROM s WHERE key = 'R')")
def _(spark, sf):
    return sets.sintercard(flag_parts(spark, sf), ["A", "R"], 50)


@query("s_card", f"WITH {S} SELECT key, count(DISTINCT member) AS n FROM s GROUP BY 1")
def _(spark, sf):
    return flag_parts(spark, sf).groupBy("key").agg(F.count_distinct("member").alias("n"))


@query("s_mismember", f"WITH {S}, w AS (SELECT unnest(range(1, 60)) AS pos, unnest(range(1, 60)) * 3 AS member) SELECT pos, member, CASE WHEN member IN (SELECT member FROM s WHERE key = 'A') THEN 1 ELSE 0 END AS is_member FROM w")
def _(spark, sf):
    return sets.smismember(flag_parts(spark, sf), "A", spark.range(1, 60).select(F.col("id").alias("pos"), (F.col("id") * 3).alias("member")))


@query("s_add_rem", f"WITH {S} SELECT key, count(*) AS n FROM s WHERE member % 7 <> 0 GROUP BY 1")
def _(spark, sf):
    return flag_parts(spark, sf).where("member % 7 <> 0").groupBy("key").agg(F.count("*").alias("n"))


@query("s_randmember", "SELECT 15 AS n, true AS held")
def _(spark, sf):
    s = flag_parts(spark, sf)
    drawn = sets.srandmember(s, "A", 5).select("member").union(sets.srandmember(s, "A", -10).select("member"))
    return drawn.join(sets.members(s, "A"), "member", "left_semi").agg(F.count("*").cast("int").alias("n"), (F.count("*") == 15).alias("held"))


@query("s_move", f"WITH {S} SELECT CASE WHEN key = 'A' AND member = (SELECT min(member) FROM s WHERE key = 'A') THEN 'R' ELSE key END AS k, count(DISTINCT member) AS n FROM s GROUP BY 1")
def _(spark, sf):
    s = flag_parts(spark, sf)
    least = s.where("key = 'A'").agg(F.min("member")).first()[0]
    return sets.smove(s, "A", "R", least).groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n"))


# Ranked sets
@query("z_rank", f"WITH {Z} SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM z")
def _(spark, sf):
    return zsets.zrank(segments(spark, sf))


@query("z_revrange_topk", f"WITH {Z} SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM z QUALIFY rank < 5")
def _(spark, sf):
    return zsets.zrange(segments(spark, sf), 0, 4, reverse=True)


@query("z_range_negative", f"WITH {Z} SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM z QUALIFY rank >= count(*) OVER (PARTITION BY key) - 3")
def _(spark, sf):
    return zsets.zrange(segments(spark, sf), -3, -1)


@query("z_rangebyscore_excl", f"WITH {Z} SELECT * FROM z WHERE score > 100 AND score <= 5000")
def _(spark, sf):
    return zsets.zrangebyscore(segments(spark, sf), "(100", "5000")


@query("z_count", f"WITH {Z} SELECT key, count(*) AS n FROM z WHERE score BETWEEN 100 AND 5000 GROUP BY 1")
def _(spark, sf):
    return zsets.zcount(segments(spark, sf), "(100", "(5000")


@query("z_card_score", f"WITH {Z} SELECT key, count(*) AS n, max(CASE WHEN member = 'Customer#000000001' THEN score END) AS score FROM z GROUP BY 1")
def _(spark, sf):
    z = segments(spark, sf)
    return z.groupBy("key").agg(F.count("*").alias("n"), F.max(F.when(F.col("member") == "Customer#000000001", F.col("score"))).alias("score"))


@query("z_rangebylex", f"WITH {Z} SELECT * FROM z WHERE member >= 'Customer#000000010' AND member < 'Customer#000000090'")
def _(spark, sf):
    return zsets.zrangebylex(segments(spark, sf), "[Customer#000000010", "(Customer#000000090")


@query("z_incrby", "SELECT o_orderpriority AS key, o_custkey AS member, sum(floor(o_totalprice)) AS score FROM orders GROUP BY 1, 2")
def _(spark, sf):
    o = load(spark, sf, "orders")
    return zsets.zincrby(o.select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("member"), F.floor("o_totalprice").cast("double").alias("score")))


@query("z_add_last", "SELECT o_orderpriority AS key, o_custkey AS member, max_by(o_totalprice, o_orderkey) AS score FROM orders GROUP BY 1, 2")
def _(spark, sf):
    o = load(spark, sf, "orders")
    return zsets.zadd(o.select(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("member"), F.col("o_totalprice").alias("score")))


@query("z_remrangebyrank", f"WITH {Z} SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY key ORDER BY score, member) > 3")
def _(spark, sf):
    return zsets.zremrangebyrank(segments(spark, sf), 0, 2).select("key", "member", "score")


@query("z_remrangebyscore", f"WITH {Z} SELECT * FROM z WHERE NOT (score >= 0 AND score < 9000)")
def _(spark, sf):
    return zsets.zremrangebyscore(segments(spark, sf), "0", "(9000")


@query("z_popmin_max", f"WITH {Z} SELECT key, member, score FROM z QUALIFY row_number() OVER (PARTITION BY key ORDER BY score, member) <= 2 UNION ALL SELECT key, member, score FROM z QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) <= 2")
def _(spark, sf):
    z = segments(spark, sf)
    return zsets.zpop(z, 2).union(zsets.zpop(z, 2, largest=True))


_ZU = "zo AS (SELECT o_orderpriority AS key, o_custkey AS member, max(floor(o_totalprice)) AS score FROM orders GROUP BY 1, 2), w AS (SELECT member, key, score * CASE WHEN key = '1-URGENT' THEN 2 ELSE 3 END AS s FROM zo WHERE key IN ('1-URGENT', '5-LOW'))"


def priorities(spark, sf):
    o = load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("member"))
    return o.agg(F.max(F.floor("o_totalprice")).cast("double").alias("score"))


for _how in ("sum", "min", "max"):

    @query(f"z_union_{_how}", f"WITH {_ZU} SELECT member, {_how}(s) AS score FROM w GROUP BY 1")
    def _(spark, sf, how=_how):
        return zsets.weighted(priorities(spark, sf), {"1-URGENT": 2, "5-LOW": 3}, how)

    @query(f"z_inter_{_how}", f"WITH {_ZU} SELECT member, {_how}(s) AS score FROM w GROUP BY 1 HAVING count(*) = 2")
    def _(spark, sf, how=_how):
        return zsets.weighted(priorities(spark, sf), {"1-URGENT": 2, "5-LOW": 3}, how, every=True)


@query("z_diff", f"WITH {_ZU} SELECT member, score FROM zo WHERE key = '1-URGENT' AND member NOT IN (SELECT member FROM zo WHERE key = '5-LOW')")
def _(spark, sf):
    return zsets.zdiff(priorities(spark, sf), "1-URGENT", ["5-LOW"])


@query("z_intercard", f"WITH {_ZU} SELECT least(count(*), 20) AS n FROM (SELECT member FROM w GROUP BY 1 HAVING count(*) = 2)")
def _(spark, sf):
    return zsets.zintercard(priorities(spark, sf), ["1-URGENT", "5-LOW"], 20)


@query("z_randmember", "SELECT 6 AS n")
def _(spark, sf):
    z = segments(spark, sf)
    return z.orderBy(F.xxhash64("member", F.lit(1)), "member").limit(6).agg(F.count("*").cast("int").alias("n"))


# Conditional writes, databases, pages of elements
def writes(spark, sf):
    """Every third order's key and as many new ones, with its clerk as the value and no expiry."""
    o = load(spark, sf, "orders").where("o_orderkey % 3 = 0")
    old = o.select(F.concat(F.lit("order:"), "o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))
    new = o.select(F.concat(F.lit("extra:"), "o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))
    return old.union(new).withColumn("expire_ms", F.lit(None).cast("long"))


W = "w AS (SELECT p || o_orderkey AS key, o_orderstatus AS value FROM orders, (SELECT unnest(['order:', 'extra:']) AS p) WHERE o_orderkey % 3 = 0)"
BOTH = f"WITH {KV}, {W}, b AS (SELECT coalesce(kv.key, w.key) AS key, kv.value AS old, w.value AS new, kv.expire_ms AS was, kv.key IS NOT NULL AS known, w.key IS NOT NULL AS given FROM kv FULL JOIN w USING (key))"


@query("set_nx", f"{BOTH} SELECT key, coalesce(old, new) AS value, was AS expire_ms FROM b")
def _(spark, sf):
    return keyspace.put(kv(spark, sf), writes(spark, sf), only_new=True)


@query("set_xx", f"{BOTH} SELECT key, coalesce(new, old) AS value, CASE WHEN NOT given THEN was END AS expire_ms FROM b WHERE known")
def _(spark, sf):
    return keyspace.put(kv(spark, sf), writes(spark, sf), only_known=True)


@query("set_keepttl", f"{BOTH} SELECT key, coalesce(new, old) AS value, was AS expire_ms FROM b")
def _(spark, sf):
    return keyspace.put(kv(spark, sf), writes(spark, sf), keep_expiry=True)


@query("msetnx", f"WITH {KV}, {W} SELECT key, value FROM kv UNION ALL SELECT key, value FROM w WHERE key LIKE 'extra:%'")
def _(spark, sf):
    space = kv(spark, sf)
    refused = keyspace.put_all_or_none(space, writes(spark, sf))
    return keyspace.put_all_or_none(refused, writes(spark, sf).where(F.col("key").startswith("extra:"))).select("key", "value")


@query("getset", f"WITH {KV}, {W} SELECT w.key, kv.value FROM w LEFT JOIN kv USING (key)")
def _(spark, sf):
    return keyspace.get_and_put(kv(spark, sf), writes(spark, sf))


@query("getdel", f"WITH {KV}, {W} SELECT key, value FROM kv WHERE key NOT IN (SELECT key FROM w)")
def _(spark, sf):
    return keyspace.get_and_delete(kv(spark, sf), writes(spark, sf).select("key"))[1].select("key", "value")


@query("touch", f"WITH {KV}, {W} SELECT count(*) AS n FROM w WHERE key IN (SELECT key FROM kv)")
def _(spark, sf):
    return keyspace.exists(kv(spark, sf), writes(spark, sf))


@query("move_db", f"WITH {KV}, d AS (SELECT o_orderkey % 2 AS db, CASE WHEN o_orderkey % 4 < 2 THEN key ELSE 'twin:' || (o_orderkey // 4) END AS key FROM kv) SELECT CASE WHEN db = 0 AND key NOT IN (SELECT key FROM d WHERE db = 1) THEN 1 ELSE db END AS db, key FROM d")
def _(spark, sf):
    twin = F.concat(F.lit("twin:"), F.floor(F.col("o_orderkey") / 4))
    space = kv(spark, sf).select((F.col("o_orderkey") % 2).alias("db"), F.when(F.col("o_orderkey") % 4 < 2, F.col("key")).otherwise(twin).alias("key"))
    return keyspace.move(space, F.col("db") == 0, 1)


@query("swap_db", f"WITH {KV} SELECT (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END)::BIGINT AS db, key FROM kv")
def _(spark, sf):
    return keyspace.swap_databases(kv(spark, sf).select((F.col("o_orderkey") % 3).alias("db"), "key"), 0, 1)


@query("z_scan", f"WITH {Z}, p AS (SELECT key, member, score FROM z QUALIFY row_number() OVER (PARTITION BY key ORDER BY member) BETWEEN 11 AND 60) SELECT * FROM p WHERE member LIKE '%7'")
def _(spark, sf):
    return keyspace.scan_elements(segments(spark, sf), "member", 10, 50, "*7")


@query("z_lexcount", f"WITH {Z} SELECT key, count(*) AS n FROM z WHERE member > 'Customer#000000010' AND member <= 'Customer#000000500' GROUP BY 1")
def _(spark, sf):
    return zsets.zlexcount(segments(spark, sf), "(Customer#000000010", "[Customer#000000500")


@query("z_remrangebylex", f"WITH {Z} SELECT * FROM z WHERE member < 'Customer#000000100'")
def _(spark, sf):
    return zsets.zremrangebylex(segments(spark, sf), "[Customer#000000100", "+")


@query("z_rangebyscore_limit_rev", f"WITH {Z} SELECT * FROM z WHERE score BETWEEN 0 AND 5000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) BETWEEN 4 AND 13")
def _(spark, sf):
    return zsets.zpage(zsets.zrangebyscore(segments(spark, sf), "0", "5000"), 3, 10, reverse=True)


@query("z_rangestore", f"WITH {Z}, f AS (SELECT 'top' AS key, member, score FROM z WHERE key = 'BUILDING' ORDER BY score DESC, member DESC LIMIT 20) SELECT * FROM z UNION ALL SELECT * FROM f")
def _(spark, sf):
    z = segments(spark, sf)
    return zsets.zstore(z, "top", zsets.zpage(z.where("key = 'BUILDING'"), 0, 20, reverse=True))


@query("z_add_gt", f"WITH {Z} SELECT key, member, greatest(score, 5000.0::DOUBLE) AS score FROM z")
def _(spark, sf):
    z = segments(spark, sf)
    return zsets.zadd_only(z, z.withColumn("score", F.lit(5000.0)), "gt")


@query("z_add_nx", f"WITH {Z} SELECT * FROM z UNION ALL SELECT key, 'new ' || member, 1.0 FROM z WHERE score < 0")
def _(spark, sf):
    z = segments(spark, sf)
    low = z.where("score < 0")
    new = low.select("key", F.concat(F.lit("new "), "member").alias("member"), F.lit(1.0).alias("score"))
    return zsets.zadd_only(z, low.withColumn("score", F.lit(9.0)).unionByName(new), "nx")


@query("l_pushx", f"WITH {L} SELECT o_custkey, CASE WHEN len(f) > 0 THEN [0] || f ELSE f END AS v FROM (SELECT o_custkey, list_filter(l, lambda x: x % 2 = 0) AS f FROM l)")
def _(spark, sf):
    even = F.filter("l", lambda x: x % 2 == 0)
    return customer_lists(spark, sf).select("o_custkey", lists.pushx(even, F.lit(0).cast("long"), left=True).alias("v"))
