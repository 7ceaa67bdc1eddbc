"""Queries for JSON, vectors, retrieval, graphs, text functions and operational aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as words
from tessera.operators import json_ops, ops, textops, vectors
from tessera.plans.registry import query
from tessera.tables import load

DAY = 86_400_000


# JSON
def nested(spark, sf):
    """One document a customer with nested values that follow from its columns."""
    c = load(spark, sf, "customer")
    inner = F.struct(F.col("c_nationkey").alias("x"), F.col("c_mktsegment").alias("y"))
    items = F.array(*[F.struct((F.col("c_custkey") * k % 6).alias("qty"), F.lit(f"n{k}").alias("name")) for k in (1, 2, 3)])
    return c.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("a"), inner.alias("b"), items.alias("items"), (F.col("c_custkey") % 2 == 0).alias("d"))).alias("doc"))


@query("json_path_get", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, sf):
    return load(spark, sf, "events").select("event_id", json_ops.get(F.col("props"), "$.k").alias("k"))


@query("json_nested_get", "SELECT c_custkey, c_mktsegment AS y, (c_custkey * 2 % 6)::VARCHAR AS q FROM customer")
def _(spark, sf):
    d = F.col("doc")
    return nested(spark, sf).select("c_custkey", json_ops.get(d, "$.b.y").alias("y"), json_ops.get(d, "$.items[1].qty").alias("q"))


@query("json_wildcard", "SELECT c_custkey, [c_custkey % 6, c_custkey * 2 % 6, c_custkey * 3 % 6]::VARCHAR[] AS q FROM customer")
def _(spark, sf):
    return nested(spark, sf).select("c_custkey", json_ops.get_all(F.col("doc"), "$.items[*].qty").alias("q"))


@query("json_filter", "SELECT c_custkey, ((c_custkey % 6 > 2)::INT + (c_custkey * 2 % 6 > 2)::INT + (c_custkey * 3 % 6 > 2)::INT)::BIGINT AS n FROM customer")
def _(spark, sf):
    return nested(spark, sf).select("c_custkey", json_ops.count(F.col("doc"), "$.items[?(@.qty > 2)]").alias("n"))


@query("json_filter_logic", "SELECT c_custkey, ((c_custkey % 6 = 1 OR false)::INT + (c_custkey * 2 % 6 = 1 OR true)::INT + (c_custkey * 3 % 6 = 1)::INT)::BIGINT AS n FROM customer")
def _(spark, sf):
    return nested(spark, sf).select("c_custkey", json_ops.count(F.col("doc"), "$.items[?(@.qty == 1 || @.name =~ '*2')]").alias("n"))


@query("json_recursive", "SELECT c_custkey, 3::BIGINT AS n FROM customer")
def _(spark, sf):
    return nested(spark, sf).select("c_custkey", json_ops.count(F.col("doc"), "$..name").alias("n"))


@query("json_type", "SELECT c_custkey, 'object' AS b, 'integer' AS a, 'array' AS i, 'boolean' AS d, 'string' AS y FROM customer")
def _(spark, sf):
    d = F.col("doc")
    paths = {"b": "$.b", "a": "$.a", "i": "$.items", "d": "$.d", "y": "$.b.y"}
    return nested(spark, sf).select("c_custkey", *[json_ops.type_of(d, p).alias(n) for n, p in paths.items()])


@query("json_objkeys_len", "SELECT c_custkey, ['a', 'b', 'items', 'd'] AS k, 3 AS n FROM customer")
def _(spark, sf):
    return nested(spark, sf).select("c_custkey", F.json_object_keys("doc").alias("k"), F.json_array_length(F.get_json_object("doc", "$.items")).alias("n"))


@query("json_numincrby", "SELECT c_custkey, (c_custkey + 5)::VARCHAR AS a, (c_nationkey * 3)::VARCHAR AS x FROM customer")
def _(spark, sf):
    d = json_ops.multiply(json_ops.add(F.col("doc"), "$.a", 5), "$.b.x", 3)
    return nested(spark, sf).select("c_custkey", d.alias("doc")).select("c_custkey", F.get_json_object("doc", "$.a").alias("a"), F.get_json_object("doc", "$.b.x").alias("x"))


@query("json_set_del", "SELECT c_custkey, 'new' AS z, NULL::VARCHAR AS y, c_custkey::VARCHAR AS a FROM customer")
def _(spark, sf):
    d = json_ops.delete(json_ops.set_value(json_ops.set_value(F.col("doc"), "$.b.z", "new"), "$.a", 0, "NX"), "$.b.y")
    out = nested(spark, sf).select("c_custkey", d.alias("doc"))
    return out.select("c_custkey", *[F.get_json_object("doc", p).alias(n) for n, p in (("z", "$.b.z"), ("y", "$.b.y"), ("a", "$.a"))])


@query("json_arrays", "SELECT c_custkey, 5::BIGINT AS n, '7' AS last FROM customer")
def _(spark, sf):
    d = json_ops.arr(F.col("doc"), "$.items", lambda x: [9, *x, 7])
    return nested(spark, sf).select("c_custkey", json_ops.count(d, "$.items[*]").alias("n"), json_ops.get(d, "$.items[-1]").alias("last"))


@query("json_toggle_clear", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'false' ELSE 'true' END AS d, '[]' AS items FROM customer")
def _(spark, sf):
    d = json_ops.clear(json_ops.toggle(F.col("doc"), "$.d"), "$.items")
    return nested(spark, sf).select("c_custkey", json_ops.get(d, "$.d").alias("d"), json_ops.get(d, "$.items").alias("items"))


@query("json_strappend", "SELECT c_custkey, c_mktsegment || '!' AS y FROM customer")
def _(spark, sf):
    return nested(spark, sf).select("c_custkey", json_ops.get(json_ops.str_append(F.col("doc"), "$.b.y", "!"), "$.b.y").alias("y"))


@query("json_merge_patch", "SELECT c_custkey, json_merge_patch(json_object('a', c_custkey, 'b', json_object('x', c_nationkey)), '{\"a\": null, \"b\": {\"z\": 1}}')::VARCHAR AS doc FROM customer")
def _(spark, sf):
    c = load(spark, sf, "customer")
    doc = F.to_json(F.struct(F.col("c_custkey").alias("a"), F.struct(F.col("c_nationkey").alias("x")).alias("b")))
    return c.select("c_custkey", json_ops.merge(doc, F.lit('{"a": null, "b": {"z": 1}}')).alias("doc"))


@query("json_validate", "SELECT c_custkey, (CASE WHEN c_custkey > 100 THEN 1 ELSE 0 END + CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END)::INT AS broken FROM customer")
def _(spark, sf):
    schema = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer", "maximum": 100}, "b": {"type": "object", "properties": {"y": {"enum": ["BUILDING", "MACHINERY"]}}}}}
    return nested(spark, sf).select("c_custkey", F.size(json_ops.validate(F.col("doc"), schema)).alias("broken"))


@query("doc_patches", "SELECT o_custkey::VARCHAR AS key, count(*) AS version, max_by(o_orderkey, o_orderkey)::VARCHAR AS last FROM orders GROUP BY 1")
def _(spark, sf):
    patch = F.format_string('[{"op":"add","path":"/last","value":%d}]', F.col("o_orderkey"))
    log = load(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("version"), patch.alias("patch"))
    return json_ops.fold_patches(log).select("key", "version", F.get_json_object("doc", "$.last").alias("last"))


# Vectors
def vecs(spark, sf):
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


_VQ = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7)"
_VD = {
    "cosine": "1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[])",
    "l2": "list_sum(list_transform(list_zip(embedding::DOUBLE[], q::DOUBLE[]), lambda p: pow(p[1] - p[2], 2)))",
    "ip": "-list_dot_product(embedding::DOUBLE[], q::DOUBLE[])",
}
for _metric, _sql in _VD.items():

    @query(f"knn_{_metric}", f"WITH {_VQ}, d AS (SELECT vec_id AS id, {_sql} AS dist FROM embeddings, q) SELECT id, round(dist, 5) AS distance FROM d ORDER BY dist, id LIMIT 10")
    def _(spark, sf, metric=_metric):
        v = vecs(spark, sf)
        q = v.where("id = 7").first()["vec"]
        return vectors.knn(v, q, 10, metric).select("id", F.round("distance", 5).alias("distance"))


@query("knn_join_topk", f"SELECT a.vec_id AS query_id, b.vec_id AS id FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_VD['l2'].replace('embedding', 'b.embedding').replace('q::', 'a.embedding::')}, b.vec_id) <= 3")
def _(spark, sf):
    v = vecs(spark, sf)
    return vectors.knn_join(v.where("id % 50 = 0"), v, 3, "l2").select("query_id", "id")


@query("vector_stats", "SELECT label, count(*) AS n, max(len(embedding)) AS dim FROM embeddings GROUP BY 1")
def _(spark, sf):
    return vecs(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("vec")).cast("long").alias("dim"))


@query("semantic_get", f"WITH {_VQ} SELECT vec_id AS id FROM embeddings, q WHERE list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) >= 0.3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, id LIMIT 1")
def _(spark, sf):
    v = vecs(spark, sf)
    return vectors.nearest_key(v, v.where("id = 7").first()["vec"], 0.3).select("id")


@query("embed_norms", "SELECT p_partkey, 1.0::DOUBLE AS norm FROM part")
def _(spark, sf):
    e = load(spark, sf, "part").select("p_partkey", vectors.embed(128)(F.col("p_name")).alias("v"))
    return e.select("p_partkey", F.round(F.sqrt(vectors.dot(F.col("v"), F.col("v"))), 3).alias("norm"))


@query("retrieve_query")
def _(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    v = vecs(spark, sf)
    dense = vectors.knn(v, v.where("id = 7").first()["vec"], 40).select("id", (1 - F.col("distance")).alias("score"))
    return vectors.retrieve(vectors.bm25_leg(d, ["pour", "par"]), dense, 10)


@query("retrieve_bm25", r"""WITH t AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: strlen(w) >= 2) AS t FROM documents), n AS (SELECT count(*) AS n FROM documents),
x AS (SELECT id, w, len(list_filter(t, lambda y: y = w)) AS tf FROM t, (SELECT unnest(['pour', 'par']) AS w)), f AS (SELECT * FROM x WHERE tf > 0), df AS (SELECT w, count(*) AS df FROM f GROUP BY 1)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)), 5) AS score FROM f JOIN df USING (w), n GROUP BY 1""")
def _(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return vectors.bm25_leg(d, ["pour", "par"]).select("id", F.round("score", 5).alias("score"))


# Graphs: regions hold nations, nations hold customers
def triples(spark, sf):
    n = load(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("s"), F.lit("holds").alias("p"), F.concat(F.lit("n"), "n_nationkey").alias("o"))
    c = load(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("s"), F.lit("home").alias("p"), F.concat(F.lit("c"), "c_custkey").alias("o"))
    return n.union(c)


G = "g AS (SELECT 'r' || n_regionkey AS s, 'holds' AS p, 'n' || n_nationkey AS o FROM nation UNION ALL SELECT 'n' || c_nationkey, 'home', 'c' || c_custkey FROM customer)"


@query("graph_neighbors", f"WITH {G} SELECT DISTINCT p, o FROM g WHERE s = 'r1'")
def _(spark, sf):
    return vectors.neighbours(triples(spark, sf), "r1")


@query("graph_stats", f"WITH {G} SELECT count(*) AS edges, count(DISTINCT s) AS subjects FROM g")
def _(spark, sf):
    return triples(spark, sf).agg(F.count("*").alias("edges"), F.count_distinct("s").alias("subjects"))


@query("graph_expand", f"WITH {G} SELECT s, p, o, 1 AS depth FROM g WHERE s = 'r2' UNION ALL SELECT b.s, b.p, b.o, 2 FROM g a JOIN g b ON a.o = b.s WHERE a.s = 'r2'")
def _(spark, sf):
    start = spark.createDataFrame([("r2",)], "node string")
    return vectors.expand(triples(spark, sf), start, 2)


@query("graph_path_len", f"WITH RECURSIVE {G}, w AS (SELECT 'r0' AS n, 0 AS d UNION SELECT o, d + 1 FROM w JOIN g ON s = n WHERE d < 6) SELECT coalesce(min(d), -1) AS hops FROM w WHERE n = 'c11'")
def _(spark, sf):
    hops = vectors.path_length(triples(spark, sf), "r0", "c11")
    return spark.createDataFrame([(-1 if hops is None else hops,)], "hops int")


_LIKES = "l AS (SELECT o_custkey AS u, l_suppkey AS i, count(*)::DOUBLE AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"


@query("recommend_topk", f"WITH {_LIKES}, nn AS (SELECT u, sqrt(sum(w * w)) AS n FROM l GROUP BY 1), m AS (SELECT * FROM l WHERE u = 1), d AS (SELECT l.u, sum(l.w * m.w) AS dot FROM l JOIN m ON l.i = m.i WHERE l.u <> 1 GROUP BY 1), s AS (SELECT d.u, dot / (nn.n * (SELECT n FROM nn WHERE u = 1)) AS sim FROM d JOIN nn USING (u)) SELECT i AS item, round(sum(sim * w), 5) AS score FROM l JOIN s USING (u) WHERE i NOT IN (SELECT i FROM m) GROUP BY 1 ORDER BY sum(sim * w) DESC, item LIMIT 5")
def _(spark, sf):
    o, i = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    likes = o.join(i, o["o_orderkey"] == i["l_orderkey"]).groupBy(F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item")).agg(F.count("*").cast("double").alias("weight"))
    return vectors.recommend(likes, 1, 5).select("item", F.round("score", 5).alias("score"))


@query("memory_decay", "SELECT event_type, count(*) AS n FROM events WHERE 0.3 * (value / 500) + 0.7 * greatest(0.1, exp(-(event_id % 90) / 30.0)) >= 0.3 GROUP BY 1")
def _(spark, sf):
    blend = vectors.memory_blend(F.col("value") / 500, F.lit(0.1), F.col("event_id") % 90, 0.7)
    return load(spark, sf, "events").where(blend >= 0.3).groupBy("event_type").agg(F.count("*").alias("n"))


@query("memory_consolidate")
def _(spark, sf):
    v = vecs(spark, sf).select(F.col("label").cast("string").alias("user"), F.col("id").cast("string").alias("text"), "vec", (F.col("id") % 7).cast("double").alias("importance"), F.col("id").alias("created"))
    return vectors.consolidate(v, 0.3)


# Text
@query("tok_count", """WITH s AS (SELECT doc_id, strlen(text) AS n, length(text) - length(translate(text, E' \\t\\n\\r', '')) AS b, length(text) - length(translate(text, '.,;:!?-_()[]{}"''`', '')) AS p FROM documents)
SELECT doc_id, floor(n / greatest(2.5, 4.0 + b / n * 0.6 - p / n * 0.5) * 1.05 + 0.5)::BIGINT AS n FROM s""")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", textops.token_count(F.col("text"), "gpt-4").alias("n"))


@query("tok_split")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.posexplode(textops.token_split("gpt-4", 200)(F.col("text"))).alias("pos", "part"))


@query("chunk_char", "SELECT doc_id, unnest(range(len(s))) AS pos, unnest(list_transform(s, lambda i: substr(text, i + 1, 300))) AS part FROM (SELECT doc_id, text, range(0, greatest(length(text) - 50, 1), 250) AS s FROM documents)")
def _(spark, sf):
    parts = load(spark, sf, "documents").select("doc_id", F.posexplode(textops.chunk_chars(F.col("text"), 300, 50)).alias("pos", "part"))
    return parts.withColumn("pos", F.col("pos").cast("long"))


@query("chunk_sentence", r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?])(\s)', E'\\1\n', 'g'), E'\n'))) AS s FROM documents) WHERE s <> '' GROUP BY 1")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.size(textops.sentences(F.col("text"))).cast("long").alias("n")).where("n > 0")


@query("redact_counts", r"SELECT doc_id, len(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) AS email FROM documents")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", textops.redaction_counts(F.col("text"))["email"].cast("long").alias("email"))


@query("redact_restore", "SELECT doc_id, text FROM documents")
def _(spark, sf):
    r = load(spark, sf, "documents").select("doc_id", textops.redact()(F.col("text")).alias("r"))
    return r.select("doc_id", textops.restore(F.col("r.text"), F.col("r.originals")).alias("text"))


@query("inject_scan", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)ignore (all |everything )?(previous|prior|the (above|prior)) (instruction|message|prompt|rule|context)s?') THEN 'ignore-previous' END AS sign FROM conversations WHERE conv_id < 1000000")
def _(spark, sf):
    c = load(spark, sf, "conversations")
    only_first = F.when(textops.injection(F.col("text")) == "ignore-previous", "ignore-previous")
    return c.select("conv_id", "turn", only_first.alias("sign"))


@query("inject_scan_all")
def _(spark, sf):
    c = load(spark, sf, "conversations")
    return c.select("conv_id", "turn", textops.injections(F.col("text")).alias("signs"), textops.injection_severity(F.col("text")).alias("severity"))


@query("fingerprint_groups", r"""WITH c AS (SELECT trim(translate(regexp_replace(translate(regexp_replace(lower(regexp_replace(' ' || text, '(\s)https?://\S*', E'\\1\x01', 'g')), '[0-9]+', E'\x02', 'g'), '!?.,;:-_()[]{}"''`', ''), '\s+', ' ', 'g'), E'\x01\x02', 'UD')) AS f FROM conversations) SELECT count(*) AS n, count(DISTINCT f) AS groups FROM c""")
def _(spark, sf):
    c = load(spark, sf, "conversations").select(textops.canonical(F.col("text")).alias("f"))
    return c.agg(F.count("*").alias("n"), F.count_distinct("f").alias("groups"))


@query("ground_jaccard")
def _(spark, sf):
    b = load(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("source"))
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return textops.ground(d, b)


@query("verify_exact", "WITH c AS (SELECT o_custkey AS query, o_orderstatus AS answer, count(*) AS n FROM orders GROUP BY 1, 2) SELECT query, max_by(answer, (n, answer)) AS chosen, max(n) / sum(n) AS confidence, count(*) AS buckets FROM c GROUP BY 1")
def _(spark, sf):
    return textops.consensus_exact(load(spark, sf, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderstatus").alias("sample")))


@query("verify_medoid")
def _(spark, sf):
    c = load(spark, sf, "conversations").select(F.col("conv_id").alias("query"), F.col("turn").alias("pos"), F.col("text").alias("sample"))
    return textops.consensus_medoid(c)


@query("judge_passrate", "WITH r AS (SELECT event_type AS prompt, value > 60 AS ok FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 50) SELECT prompt, avg(ok::INT::DOUBLE) AS rate, count(*) AS n FROM r GROUP BY 1")
def _(spark, sf):
    runs = load(spark, sf, "events").select(F.col("event_type").alias("prompt"), F.col("event_id").alias("ts"), (F.col("value") > 60).alias("pass"))
    return textops.pass_rate(runs, 50)


@query("judge_grade", "SELECT p_partkey, true AS exact, contains(lower(p_name), 'part') AS has, abs(p_size - 10) <= 5 AS near FROM part")
def _(spark, sf):
    p = load(spark, sf, "part")
    grade = lambda e, a, g, t=0.0: textops.grade(e, a, F.lit(g), F.lit(t))
    return p.select("p_partkey", grade(F.col("p_name"), F.concat(F.lit(" "), "p_name"), "exact").alias("exact"), grade(F.lit("PART"), F.col("p_name"), "contains").alias("has"), grade(F.lit("10"), F.col("p_size").cast("string"), "numeric_within", 5.0).alias("near"))


@query("conv_window", "WITH w AS (SELECT conv_id AS conv, turn, sum(ceil(strlen(text) / 4)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations) SELECT conv, turn, used::BIGINT AS used FROM w WHERE used <= 120 OR i = 1")
def _(spark, sf):
    t = load(spark, sf, "conversations").select(F.col("conv_id").alias("conv"), "turn", "text")
    return textops.conversation_window(t, 120).select("conv", "turn", F.col("used").cast("long").alias("used"))


@query("cite_extract", r"SELECT doc_id, len(regexp_extract_all(text, '\[(\d+|[A-Za-z][A-Za-z0-9_-]*)\]')) AS n FROM documents")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.size(textops.citations(F.col("text"))).cast("long").alias("n"))


@query("shrink_ws", r"SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM documents")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.length(textops.shrink_white_space(F.col("text"))).cast("long").alias("n"))


@query("prompt_render", "SELECT p_partkey, 'Name ' || p_name || ', brand ' || p_brand || ', {none}' AS body FROM part")
def _(spark, sf):
    v = F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand")
    return load(spark, sf, "part").select("p_partkey", textops.render(F.lit("Name {name}, brand {brand}, {none}"), v).alias("body"))


@query("context_assemble")
def _(spark, sf):
    s = load(spark, sf, "conversations").select(F.col("conv_id").alias("ctx"), F.col("turn").alias("pos"), (F.col("turn") % 3).alias("priority"), F.octet_length("text").cast("long").alias("tokens"))
    return textops.assemble(s, 400)


@query("guardrail_run")  # SQL has no injection score; tests/test_guardrail.py has the stages' order
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", textops.guardrail(F.col("text"), 0.9, 4000, "zzzzzz").alias("stage"))


@query("retrieval_tokens", r"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: strlen(w) >= 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in words.STOPWORDS) + "))) AS n FROM documents")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.size(words.retrieval_tokens(F.col("text"))).cast("long").alias("n"))


# Operations
def calls(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return load(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), ms.alias("ts"), F.lit(1).cast("long").alias("cost"), "event_type", "value")


E_ = "e AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) // 1000 AS ts, event_type, value FROM events)"


@query("ratelimit_gcra")
def _(spark, sf):
    return ops.rate_limit(calls(spark, sf).drop("event_type", "value"), 3 * DAY, 2)


@query("circuit_states")
def _(spark, sf):
    c = calls(spark, sf).select(F.col("event_type").alias("service"), "seq", "ts", (F.col("value") < 60).alias("ok"))
    return ops.circuit(c)


@query("token_budget_fit")
def _(spark, sf):
    return ops.budget_fit(calls(spark, sf).select("key", "seq", F.col("value").alias("cost")), 150.0)


@query("cost_usage_sliding", f"WITH {E_} SELECT key, ts, round(sum(value) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN {5 * DAY} PRECEDING AND CURRENT ROW), 3) AS used FROM e")
def _(spark, sf):
    c = calls(spark, sf).select("key", "ts", F.col("value").alias("cost"))
    return ops.sliding_usage(c, 5 * DAY).select("key", "ts", F.round("used", 3).alias("used"))


@query("guard_spent", f"WITH {E_} SELECT key, round(sum(value), 3) AS spent, sum(value) > 500 AS over FROM e GROUP BY 1")
def _(spark, sf):
    s = calls(spark, sf).groupBy("key").agg(F.sum("value").alias("s"))
    return s.select("key", F.round("s", 3).alias("spent"), (F.col("s") > 500).alias("over"))


@query("asof_key_at", "WITH h AS (SELECT o_custkey AS key, o_orderdate AS ts, max_by(o_orderkey, o_orderkey) AS value FROM orders GROUP BY 1, 2) SELECT e.event_id, h.value FROM events e ASOF LEFT JOIN h ON e.user_id = h.key AND e.ts >= h.ts")
def _(spark, sf):
    o = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("ts")).agg(F.max("o_orderkey").alias("value"))
    asks = load(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", "event_id")
    return ops.as_of(o, asks).select("event_id", "value")


@query("slo_percentiles", "WITH r AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT event_type, v[least(floor(len(v) * 0.5)::INT, len(v) - 1) + 1] AS p50, v[least(floor(len(v) * 0.95)::INT, len(v) - 1) + 1] AS p95 FROM r")
def _(spark, sf):
    return ops.percentiles(load(spark, sf, "events"), "event_type", [0.5, 0.95])


@query("latency_histogram", "SELECT event_type, pow(2, ceil(log2(greatest(value, 1.0))))::BIGINT AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    return ops.histogram(load(spark, sf, "events"), "event_type")


@query("metrics_timeline", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    return load(spark, sf, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("slowlog", "SELECT event_id, value FROM events WHERE value >= 100 ORDER BY ts DESC, event_id DESC LIMIT 20")
def _(spark, sf):
    return load(spark, sf, "events").where("value >= 100").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "value")


@query("observe_counters", "SELECT event_type AS name, user_id % 4 AS label, round(sum(value), 3) AS total, max_by(value, event_id) AS gauge FROM events GROUP BY 1, 2")
def _(spark, sf):
    e = load(spark, sf, "events").groupBy(F.col("event_type").alias("name"), (F.col("user_id") % 4).alias("label"))
    return e.agg(F.round(F.sum("value"), 3).alias("total"), F.max_by("value", "event_id").alias("gauge"))


@query("ab_stats", "WITH x AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS variant, event_type, value FROM events) SELECT variant, count_if(event_type = 'view') AS exposures, count_if(event_type = 'purchase') AS wins, round(count_if(event_type = 'purchase') / count_if(event_type = 'view'), 6) AS win_rate, round(avg(value) FILTER (event_type = 'purchase') + 1.23e-6, 5) AS avg_value FROM x GROUP BY 1")
def _(spark, sf):
    e = load(spark, sf, "events").withColumn("variant", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
    out = ops.experiment(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"))
    return out.select("variant", "exposures", "wins", F.round("win_rate", 6).alias("win_rate"), F.round(F.col("avg_value") + 1.23e-6, 5).alias("avg_value"))


@query("ab_assign_sticky", "SELECT 0::BIGINT AS moved")
def _(spark, sf):
    e = load(spark, sf, "events").select("user_id", ops.assign("exp", F.col("user_id"), {"a": 1, "b": 3}).alias("v"))
    return e.groupBy("user_id").agg(F.count_distinct("v").alias("n")).where("n > 1").agg(F.count("*").alias("moved"))


@query("flag_is", "SELECT DISTINCT user_id, CASE WHEN user_id = 3 THEN false WHEN user_id IN (3, 5) THEN true ELSE false END AS is_on FROM events")
def _(spark, sf):
    return load(spark, sf, "events").select("user_id", ops.flag(F.col("user_id"), "f", [3], [3, 5], 0.0).alias("is_on")).distinct()


@query("canary_status", "SELECT avg(value) FILTER (user_id % 5 = 0) - avg(value) FILTER (user_id % 5 <> 0) > 0 AS better FROM events")
def _(spark, sf):
    arm = lambda c: F.avg(F.when(c, F.col("value")))
    e = load(spark, sf, "events")
    return e.agg((arm(F.col("user_id") % 5 == 0) - arm(F.col("user_id") % 5 != 0) > 0).alias("better"))


@query("audit_query", "SELECT event_id AS id FROM events WHERE event_type = 'error' ORDER BY id DESC LIMIT 15")
def _(spark, sf):
    return ops.audit(load(spark, sf, "events").withColumnRenamed("event_id", "id"), 15, event_type="error").select("id")


@query("trace_durations", "SELECT l_orderkey AS span, min(l_linenumber) AS start, max(l_linenumber) - min(l_linenumber) AS duration FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    i = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"), F.count("*").alias("n")).where("n > 1")
    ev = i.select(F.col("l_orderkey").alias("span"), F.explode(F.array(F.struct(F.lit("start").alias("kind"), F.col("a").alias("ts")), F.struct(F.lit("end").alias("kind"), F.col("b").alias("ts")))).alias("e")).select("span", "e.*")
    return ops.spans(ev)


@query("worker_order", "SELECT o_orderkey AS id FROM orders WHERE o_custkey <= 500 ORDER BY o_orderpriority DESC, id LIMIT 20")
def _(spark, sf):
    jobs = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("visible_at"))
    return ops.queue_order(jobs, 500, 20).select("id")


@query("worker_fold", "SELECT l_orderkey AS id, count_if(l_returnflag = 'R') AS nacks, CASE WHEN bool_or(l_returnflag = 'A') THEN 'done' WHEN count_if(l_returnflag = 'R') >= 2 THEN 'dead' ELSE 'ready' END AS state FROM lineitem GROUP BY 1")
def _(spark, sf):
    op = F.when(F.col("l_returnflag") == "A", "ack").when(F.col("l_returnflag") == "R", "nack").otherwise("get")
    return ops.queue_fold(load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("seq"), op.alias("op")), 2)


@query("saga_compensate", "SELECT l_orderkey AS saga, list(l_returnflag || l_linenumber ORDER BY l_linenumber DESC, l_returnflag DESC) AS undo FROM lineitem GROUP BY 1 HAVING bool_or(l_linestatus = 'O')")
def _(spark, sf):
    status = F.when(F.col("l_linestatus") == "O", "failed").otherwise("done")
    s = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("saga"), F.col("l_linenumber").alias("step"), F.concat("l_returnflag", "l_linenumber").alias("comp"), status.alias("status"))
    return ops.compensations(s)


@query("crdt_g_merge", "WITH m AS (SELECT event_type, user_id, max(event_id) AS n FROM events GROUP BY 1, 2) SELECT event_type AS key, sum(n)::BIGINT AS value FROM m GROUP BY 1")
def _(spark, sf):
    return ops.g_counter(load(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("actor"), F.col("event_id").alias("n")))


@query("crdt_pn_merge", "WITH m AS (SELECT event_type, user_id, max(event_id) AS up, max(event_id % 7) AS down FROM events GROUP BY 1, 2) SELECT event_type AS key, (sum(up) - sum(down))::BIGINT AS value FROM m GROUP BY 1")
def _(spark, sf):
    return ops.pn_counter(load(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("actor"), F.col("event_id").alias("up"), (F.col("event_id") % 7).alias("down")))


@query("crdt_lww", "SELECT user_id AS key, max_by(event_type, (ts, event_id)) AS value FROM events GROUP BY 1")
def _(spark, sf):
    return ops.lww(load(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("actor"), F.col("event_type").alias("value")))


@query("crdt_or_set", "SELECT l_returnflag AS key, l_suppkey AS member, count(DISTINCT l_orderkey) AS tags FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    return ops.or_set(load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_suppkey").alias("member"), F.col("l_orderkey").alias("tag")))


@query("lineage_consumers", "SELECT DISTINCT l_orderkey AS node FROM lineitem WHERE l_partkey = 5")
def _(spark, sf):
    edges = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("output"), F.col("l_partkey").alias("source"))
    return ops.lineage(edges, 5, upstream=False)


@query("churn_invalidate", "SELECT count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, sf):
    i = load(spark, sf, "lineitem")
    return i.join(i.where("l_returnflag = 'R'").select("l_orderkey").distinct(), "l_orderkey", "left_anti").agg(F.count_distinct("l_orderkey").alias("n"))


@query("idempotent_first", f"WITH {E_} SELECT key, ts, seq FROM e QUALIFY row_number() OVER (PARTITION BY key, ts // {DAY} ORDER BY ts, seq) = 1")
def _(spark, sf):
    return ops.first_per_window(calls(spark, sf), DAY).select("key", "ts", "seq")


@query("route_next", "SELECT n_regionkey AS model, min_by(n_name, n_nationkey) AS provider FROM nation WHERE n_nationkey % 3 <> 0 GROUP BY 1")
def _(spark, sf):
    n = load(spark, sf, "nation").select(F.col("n_regionkey").alias("model"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("provider"), (F.col("n_nationkey") % 3 != 0).alias("healthy"))
    return ops.first_healthy(n)


@query("agentloop_stop", "WITH s AS (SELECT l_orderkey AS loop, l_linenumber AS step, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS q FROM lineitem) SELECT loop, min(step) AS step, 'l_quantity' AS reason FROM s WHERE q > 60 GROUP BY 1")
def _(spark, sf):
    s = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("loop"), F.col("l_linenumber").alias("step"), "l_quantity")
    return ops.stop_reason(s, {"l_quantity": 60.0})


@query("cache_hit_rate", f"WITH {E_} SELECT event_type, round(avg((value > 50)::INT), 6) AS rate, count(*) AS n FROM e GROUP BY 1")
def _(spark, sf):
    e = load(spark, sf, "events").select("event_type", (F.col("value") > 50).alias("hit"))
    return ops.hit_rate(e, "event_type").withColumn("rate", F.round("rate", 6))


@query("memo_lookup", "SELECT o_orderkey, c_name AS value, c_custkey IS NOT NULL AS hit FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0")
def _(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("value"), F.when(F.col("c_custkey") % 3 == 0, 5).otherwise(20).alias("expire_ms"))
    return ops.memo(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"], F.lit(10)).select("o_orderkey", "value", "hit")


@query("rerank_weighted", "SELECT p_partkey, p_retailprice * (1 + p_size) AS weight FROM part ORDER BY weight DESC, p_partkey LIMIT 10")
def _(spark, sf):
    return load(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") * (1 + F.col("p_size"))).alias("weight")).orderBy(F.desc("weight"), "p_partkey").limit(10)


@query("schedule_due", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-05' ORDER BY ts, event_id LIMIT 25")
def _(spark, sf):
    return load(spark, sf, "events").where("ts <= timestamp_ntz'2024-01-05 00:00:00'").orderBy("ts", "event_id").limit(25).select("event_id")


@query("fewshot_tags", "SELECT p_partkey FROM part WHERE list_has_all(string_split(p_type, ' '), ['PROMO']) AND p_size <= 10")
def _(spark, sf):
    tags = F.split("p_type", " ")
    return load(spark, sf, "part").where((F.size(F.array_except(F.array(F.lit("PROMO")), tags)) == 0) & (F.col("p_size") <= 10)).select("p_partkey")


@query("hedge_winners", "SELECT user_id AS call, min_by(event_type, (ts, event_id)) AS provider FROM events GROUP BY 1")
def _(spark, sf):
    return load(spark, sf, "events").groupBy(F.col("user_id").alias("call")).agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("provider"))


@query("tool_calls", "SELECT 'lookup|customer=' || o_custkey || ',status=' || o_orderstatus AS key, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    one = F.format_string('{"status": "%s", "customer": %d}', "o_orderstatus", "o_custkey")
    other = F.format_string('{"customer":%d,"status":"%s"}', "o_custkey", "o_orderstatus")
    calls = load(spark, sf, "orders").select(ops.tool_key(F.lit("lookup"), F.when(F.col("o_orderkey") % 2 == 0, one).otherwise(other)).alias("key"))
    return calls.groupBy("key").agg(F.count("*").alias("n"))


@query("slo_met", "WITH r AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1), p AS (SELECT event_type, v[least(floor(len(v) * 0.95)::INT, len(v) - 1) + 1] AS value FROM r) SELECT event_type, value, value <= 150 AS ok FROM p")
def _(spark, sf):
    return ops.slo(load(spark, sf, "events"), "event_type", 0.95, 150.0)


@query("cite_check", "SELECT o_orderkey AS id, i AS pos, label, label = (o_custkey % 3)::VARCHAR AS valid FROM (SELECT o_orderkey, o_custkey, unnest([0, 1]) AS i, unnest([(o_custkey % 3)::VARCHAR, (o_orderkey % 4)::VARCHAR]) AS label FROM orders)")
def _(spark, sf):
    o = load(spark, sf, "orders")
    answers = o.select(F.col("o_orderkey").alias("id"), F.format_string("as [%d] and [%d] say", F.col("o_custkey") % 3, F.col("o_orderkey") % 4).alias("text"))
    sources = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).cast("string").alias("label"))
    return textops.citation_check(answers, sources).select("id", "pos", "label", "valid")
