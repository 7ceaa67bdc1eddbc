"""Full-text search: a query language compiled to DataFrame plans over one document table.

An IndexSpec names a table's id and typed fields. compile_query turns a query into a plan that gives (doc_id, score):
words are looked up in postings that are made for the wanted terms only, numeric and tag predicates are filters on the
table, AND intersects and adds scores, OR unites and adds, NOT subtracts. Ranking is by score, then id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.num import go_float
from tessera.functions.text import search_tokens, stem
from tessera.operators.geo import SEARCH_RADIUS, UNITS, haversine

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class IndexSpec:
    """id column; text fields with weights; numeric, tag (with separator) and geo fields."""

    id: str
    text: dict[str, float] = field(default_factory=dict)
    numeric: tuple[str, ...] = ()
    tag: dict[str, str] = field(default_factory=dict)
    geo: tuple[str, ...] = ()
    score: str | None = None  # column that multiplies a document's relevance


# The query's parts
@dataclass(frozen=True)
class Node:
    kind: str
    args: tuple = ()
    field: str | None = None


_TOKEN = re.compile(r"""\s*(?:(@\w+):|("[^"]*")|(%{1,3})([^%\s]+)\3|([()|\-~])|(\{[^}]*\})|(\[[^\]]*\])|([^\s()|"{}\[\]@]+))""")


def parse(text: str) -> Node:
    """A query as a tree of and, or, not, term, prefix, phrase, fuzzy, range, tag, geo and all."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read the query at {text[at:]!r}")
        tokens.append(m)
        at = m.end()
    node, rest = _either(tokens, None)
    if rest:
        raise ValueError(f"can't read the query at {rest[0].group(0)!r}")
    return node


def _either(tokens: list, name: str | None) -> tuple[Node, list]:
    parts = []
    while True:
        node, tokens = _both(tokens, name)
        parts.append(node)
        if not tokens or tokens[0].group(5) != "|":
            return (parts[0] if len(parts) == 1 else Node("or", tuple(parts))), tokens
        tokens = tokens[1:]


def _both(tokens: list, name: str | None) -> tuple[Node, list]:
    parts = []
    while tokens and tokens[0].group(5) not in ("|", ")"):
        node, tokens = _one(tokens, name)
        parts.append(node)
    if not parts:
        return Node("all"), tokens
    return (parts[0] if len(parts) == 1 else Node("and", tuple(parts))), tokens


def _one(tokens: list, name: str | None) -> tuple[Node, list]:
    m, rest = tokens[0], tokens[1:]
    named, phrase, marks, fuzzy, sign, tags, bounds, word = m.groups()
    if sign == "-":
        node, rest = _one(rest, name)
        return Node("not", (node,)), rest
    if sign == "~":
        return _one(rest, name)
    if sign == "(":
        node, rest = _either(rest, name)
        return node, rest[1:]
    if named:
        return _one(rest, named[1:])
    if phrase is not None:
        return Node("phrase", tuple(phrase.strip('"').split()), name), rest
    if marks:
        return Node("fuzzy", (fuzzy.lower(), len(marks)), name), rest
    if tags is not None:
        return Node("tag", tuple(t.strip().lower() for t in tags[1:-1].split("|")), name), rest
    if bounds is not None:
        parts = bounds[1:-1].split()
        if len(parts) == 4:
            return Node("geo", (float(parts[0]), float(parts[1]), float(parts[2]), parts[3]), name), rest
        low, high = (float(p.lstrip("(").replace("+inf", "1e308").replace("-inf", "-1e308").replace("inf", "1e308")) for p in parts)
        return Node("range", (low, high), name), rest
    if word == "*":
        return Node("all"), rest
    if word.endswith("*"):
        return Node("prefix", (word[:-1].lower(),), name), rest
    return Node("term", (word.lower(),), name), rest


class Index:
    """Plans over one table; postings are derived, never collected."""

    def __init__(self, table: DataFrame, spec: IndexSpec):
        self.table, self.spec = table, spec

    def fields(self, name: str | None) -> dict[str, float]:
        return {name: self.spec.text[name]} if name else self.spec.text

    def tokens(self, name: str) -> DataFrame:
        return self.table.select(F.col(self.spec.id).alias("doc_id"), search_tokens(F.col(name)).alias("t"))

    def ids(self) -> DataFrame:
        return self.table.select(F.col(self.spec.id).alias("doc_id"))

    def postings(self, name: str, keep) -> DataFrame:
        """(doc_id, term, pos, len) of the terms that keep accepts, filtered before the expansion."""
        kept = F.filter(F.transform("t", lambda w, i: F.struct(w.alias("term"), i.alias("pos"))), lambda x: keep(x["term"]))
        return self.tokens(name).select("doc_id", F.size("t").alias("len"), F.explode(kept).alias("x")).select("doc_id", "len", "x.term", "x.pos")

    def stats(self, name: str) -> DataFrame:
        """One row: the number of documents, and the mean length of those that have words in the field."""
        n = F.size("t")
        return self.tokens(name).agg(F.count("*").alias("n_docs"), F.avg(F.when(n > 0, n)).alias("mean_len"))

    def bm25(self, name: str, keep) -> DataFrame:
        """(doc_id, term, score) by BM25 for the kept terms."""
        tf = self.postings(name, keep).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
        joined = tf.join(df, "term").join(F.broadcast(self.stats(name)))
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
        return joined.select("doc_id", "term", (idf * weight).alias("score"))

    def plan(self, node: Node) -> DataFrame:
        """(doc_id, score), each document once."""
        return getattr(self, f"_{node.kind}")(node)

    def _all(self, node: Node) -> DataFrame:
        return self.ids().select("doc_id", F.lit(1.0).alias("score"))

    def _and(self, node: Node) -> DataFrame:
        # negated parts only take away
        positive = [self.plan(n) for n in node.args if n.kind != "not"] or [self._all(node)]
        joined = reduce(lambda a, b: a.join(b.withColumnRenamed("score", "s__"), "doc_id").select("doc_id", (F.col("score") + F.col("s__")).alias("score")), positive)
        for n in node.args:
            if n.kind == "not":
                joined = joined.join(self.plan(n.args[0]).select("doc_id"), "doc_id", "left_anti")
        return joined

    def _or(self, node: Node) -> DataFrame:
        parts = reduce(DataFrame.unionByName, [self.plan(n) for n in node.args])
        return parts.groupBy("doc_id").agg(F.sum("score").alias("score"))

    def _not(self, node: Node) -> DataFrame:
        return self.ids().join(self.plan(node.args[0]).select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(0.0).alias("score"))

    def _sum(self, parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.sum("score").alias("score"))

    def _term(self, node: Node) -> DataFrame:
        word = stem(F.lit(node.args[0]))
        return self._sum([
            self.bm25(f, lambda t: t == word).select("doc_id", (F.col("score") * w).alias("score")) for f, w in self.fields(node.field).items()
        ])

    def _prefix(self, node: Node) -> DataFrame:
        return self._sum([
            self.postings(f, lambda t: t.startswith(node.args[0])).groupBy("doc_id").agg((F.count("*") * w * 0.5).alias("score"))
            for f, w in self.fields(node.field).items()
        ])

    def _phrase(self, node: Node) -> DataFrame:
        """Places where the stems stand in a row: each word's place less its number in the phrase must agree."""
        stems = [stem(F.lit(w.lower())) for w in node.args]
        found = []
        for name, weight in self.fields(node.field).items():
            places = self.postings(name, lambda t: reduce(lambda a, b: a | b, [t == s for s in stems]))
            numbers = F.array(*[F.when(F.col("term") == s, F.lit(k)) for k, s in enumerate(stems)])
            starts = places.select("doc_id", "pos", F.explode(numbers).alias("k")).where("k is not null")
            starts = starts.groupBy("doc_id", (F.col("pos") - F.col("k")).alias("start")).agg(F.count("*").alias("n"))
            hits = starts.where(F.col("n") == len(stems)).select("doc_id")
            first = self.bm25(name, lambda t: t == stems[0])
            found.append(first.join(hits, "doc_id", "left_semi").select("doc_id", (F.col("score") * weight * 1.5).alias("score")))
        return self._sum(found)

    def _fuzzy(self, node: Node) -> DataFrame:
        """Terms within an edit distance, weighed down by it."""
        word, distance = stem(F.lit(node.args[0])), node.args[1]
        away = F.levenshtein(F.col("term"), word)
        return self._sum([
            self.bm25(f, lambda t: (F.abs(F.length(t) - F.length(word)) <= distance) & (F.levenshtein(t, word, distance) >= 0)).select("doc_id", (F.col("score") * w / (1 + away)).alias("score"))
            for f, w in self.fields(node.field).items()
        ])

    def _filter(self, condition: Column) -> DataFrame:
        return self.table.where(condition).select(F.col(self.spec.id).alias("doc_id"), F.lit(1.0).alias("score"))

    def _range(self, node: Node) -> DataFrame:
        """Both bounds are inclusive, also where written as exclusive."""
        kind = dict(self.table.dtypes)[node.field]
        value = go_float(F.col(node.field)) if kind == "string" else F.col(node.field)
        return self._filter(value.between(*node.args))

    def tags(self, name: str) -> Column:
        parts = F.transform(F.split(F.col(name), re.escape(self.spec.tag[name])), lambda t: F.lower(F.trim(t)))
        return F.filter(parts, lambda t: t != "")

    def _tag(self, node: Node) -> DataFrame:
        return self._filter(F.arrays_overlap(self.tags(node.field), F.array(*[F.lit(t) for t in node.args])))

    def _geo(self, node: Node) -> DataFrame:
        lat, lon, distance, unit = node.args
        parts = F.split(F.col(node.field), ",")
        at = haversine(F.lit(lat), F.lit(lon), go_float(F.trim(parts[0])), go_float(F.trim(parts[1])), SEARCH_RADIUS)
        return self._filter(at <= distance * UNITS[unit])

    def search(self, query: str) -> DataFrame:
        """(doc_id, score) of a query, times the documents' own scores."""
        hits = self.plan(parse(query))
        if self.spec.score:
            own = self.table.select(F.col(self.spec.id).alias("doc_id"), F.col(self.spec.score).alias("own__"))
            hits = hits.join(own, "doc_id").select("doc_id", (F.col("score") * F.col("own__")).alias("score"))
        return hits

    def top(self, query: str, offset: int = 0, count: int = 10) -> DataFrame:
        return self.search(query).orderBy(F.desc("score"), "doc_id").offset(offset).limit(count)

    def tag_values(self, name: str) -> DataFrame:
        return self.table.select(F.explode(self.tags(name)).alias("tag")).distinct()

    def vocabulary(self, name: str) -> DataFrame:
        """(term, df)."""
        return self.tokens(name).select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))

    def spellcheck(self, name: str, words: list[str], distance: int = 1, top: int = 5) -> DataFrame:
        """Unknown words with their best known neighbours: df / (N + 1) / (distance + 1)."""
        spark = self.table.sparkSession
        known = self.vocabulary(name)
        asked = spark.createDataFrame([(w.lower(),) for w in words], "word string").withColumn("stem", stem(F.col("word")))
        unknown = asked.join(known, asked["stem"] == known["term"], "left_anti")
        n = self.ids().agg(F.count("*").alias("n_docs"))
        away = F.levenshtein(F.col("term"), F.col("stem"))
        near = known.join(F.broadcast(unknown), away <= distance).join(F.broadcast(n))
        scored = near.select("word", "term", (F.col("df") / (F.col("n_docs") + 1) / (away + 1)).alias("score"))
        rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "term"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")


def suggest(strings: DataFrame, prefix: str, fuzzy: bool = False, top: int = 5) -> DataFrame:
    """(string, score) completions of a prefix, by score, then text."""
    low = F.lower("string")
    ok = low.startswith(prefix.lower())
    if fuzzy:
        ok = ok | (F.levenshtein(F.substring(low, 1, len(prefix)), F.lit(prefix.lower())) <= 1)
    return strings.where(ok).orderBy(F.desc("score"), "string").limit(top)


def highlight(text: Column, terms: list[str], open_tag: str = "<b>", close_tag: str = "</b>") -> Column:
    """Whole-word matches in any case, wrapped."""
    pattern = r"(?i)\b(" + "|".join(re.escape(t) for t in terms) + r")\b"
    return F.regexp_replace(text, pattern, f"{open_tag}$1{close_tag}")


def summarize(text: Column, terms: list[str], window: int = 10, pieces: int = 3, separator: str = "... ") -> Column:
    """Up to some windows of words around matches that no earlier window covers; without a match the first 60 words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    hit = lambda w: F.lower(F.regexp_replace(w, r"^\W+|\W+$", "")).isin([t.lower() for t in terms])
    places = F.filter(F.transform(words, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())
    empty = F.array().cast("array<int>")
    picked = F.aggregate(
        places,
        empty,
        lambda acc, p: F.when((F.size(acc) < pieces) & ((F.size(acc) == 0) | (p >= F.try_element_at(acc, F.lit(-1)) + window)), F.concat(acc, F.array(p))).otherwise(acc),
    )
    part = lambda p: F.array_join(F.slice(words, F.greatest(p - window, F.lit(0)) + 1, window + F.least(p, F.lit(window))), " ")
    joined = F.concat(F.array_join(F.transform(picked, part), separator), F.lit(separator))
    return F.when(F.size(picked) > 0, joined).otherwise(F.array_join(F.slice(words, 1, 60), " "))


def fused(sparse: DataFrame, dense: DataFrame, w_sparse: float = 0.5, w_dense: float = 0.5, how: str = "rrf", k: int = 60, flat: float = 0.0) -> DataFrame:
    """(doc_id, score) of two scored legs: reciprocal ranks, min-max or plain scores.

    Min-max gives flat to the rows of a leg whose scores are all equal: nothing, or NaN as IEEE division (and SQL) has it.
    """

    def leg(df: DataFrame, weight: float, name: str) -> DataFrame:
        if how == "rrf":
            rank = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))
            value = F.lit(weight) / (k + F.col("rank__"))
            return df.withColumn("rank__", rank).select("doc_id", value.alias(name))
        if how == "minmax":
            ends = df.agg(F.min("score").alias("lo__"), F.max("score").alias("hi__"))
            span = F.col("hi__") - F.col("lo__")
            return df.join(F.broadcast(ends)).select("doc_id", F.when(span > 0, (F.col("score") - F.col("lo__")) / span * weight).otherwise(flat).alias(name))
        return df.select("doc_id", (F.col("score") * weight).alias(name))

    both = leg(sparse, w_sparse, "s").join(leg(dense, w_dense, "d"), "doc_id", "full_outer")
    return both.select("doc_id", (F.coalesce("s", F.lit(0.0)) + F.coalesce("d", F.lit(0.0))).alias("score"))
