"""URL filtering by listed rules and by association rules mined from labels.

Tokens are the words of a URL's host and path, marked by where they stand. FP-growth mines token combinations that are
frequent among labelled pages together with the label; a combination becomes a rule if its support and the lower 95 %
bound of its confidence reach their thresholds and no part of it is as confident. Rules are matched by an inverted index: each rule is filed under its
rarest token, pages look up their tokens, and the rule's other tokens are then checked.

Listed rules (host and path prefix) come first: a rule fits its host and all subdomains if the path starts with the
rule's path; the longest wins. Null urls and urls without "://" have empty host and path and no tokens, fit nothing and
are allowed. Repeated rows are judged alike. Extra columns are ignored; empty tables give an empty result, and without
bad labels nothing is mined.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import cut

#: (host, path prefix, verdict)
LISTED = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
MIN_SUPPORT = 0.001
MIN_CONFIDENCE = 0.5
BAD = "label=bad"


def lower_ascii(c: F.Column) -> F.Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path; both empty without "://"."""
    whole = F.coalesce(url, F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, whole.substr(at + 3, F.length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(host: F.Column, path: F.Column, rules: list = LISTED) -> tuple[F.Column, F.Column]:
    """The longest listed rule that fits, as text and verdict; null where none does."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ordered]
    rule = F.coalesce(*[F.when(fit, h + p) for fit, (h, p, _) in zip(fits, ordered, strict=True)])
    verdict = F.coalesce(*[F.when(fit, v) for fit, (_, _, v) in zip(fits, ordered, strict=True)])
    return rule, verdict


def tokens(host: F.Column, path: F.Column) -> F.Column:
    """Distinct words of host and path; digit runs become one token, so that page numbers aren't learnt by heart."""
    words = lambda c, mark: F.transform(
        F.filter(F.split(F.regexp_replace(lower_ascii(c), r"[0-9]+", "9"), r"[^0-9a-z]+"), lambda w: w != ""),
        lambda w: F.concat(F.lit(mark), w),
    )
    return F.array_distinct(F.concat(words(host, "h:"), words(path, "p:")))


def mine(marked: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """marked (tokens, bad) to rules (rule_id, tokens, confidence, support).

    Support is relative to all labelled pages. Combinations are mined among bad pages only, where they must reach the
    same absolute support; their confidence is then counted on all labelled pages through the inverted index.
    """
    n = marked.count()
    bad = marked.where("bad").select("tokens").where(F.size("tokens") > 0)
    n_bad = bad.count()
    empty = "rule_id long, tokens array<string>, confidence double, support double"
    if not n_bad:
        return marked.sparkSession.createDataFrame([], empty)
    least = max(2.0, min_support * n)
    model = FPGrowth(itemsCol="tokens", minSupport=min(1.0, least / n_bad), minConfidence=1.0).fit(bad)
    sets = model.freqItemsets.select(F.array_sort("items").alias("tokens"), "freq")
    sets = cut(sets.withColumn("rule_id", F.xxhash64("tokens")), "itemsets")
    hits = match(marked.select("tokens").withColumn("page", F.monotonically_increasing_id()), sets, rarity(marked))
    counts = hits.groupBy("rule_id").agg(F.count("*").alias("n_all"))
    rules = sets.join(counts, "rule_id").select(
        "rule_id", "tokens", (F.col("freq") / F.col("n_all")).alias("confidence"), (F.col("freq") / n).alias("support")
    )
    rules = cut(rules.where(wilson(F.col("confidence"), F.col("support") * n / F.col("confidence")) >= min_confidence), "rules")
    parts = rules.select("rule_id", "confidence", F.explode(F.transform("tokens", lambda t: F.array_except("tokens", F.array(t)))).alias("part"))
    beaten = (
        parts.join(rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("c")), "part")
        .where("c >= confidence").select("rule_id").distinct()
    )
    return cut(rules.join(beaten, "rule_id", "left_anti"), "pruned")


def wilson(p: F.Column, n: F.Column, z: float = 1.96) -> F.Column:
    """Lower bound of a share p seen in n cases."""
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def rarity(marked: DataFrame) -> DataFrame:
    return marked.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def match(pages: DataFrame, rules: DataFrame, df: DataFrame) -> DataFrame:
    """(page, rule_id) for every rule whose tokens the page all has; each rule stands in the index once."""
    filed = rules.select("rule_id", "tokens", F.explode("tokens").alias("token")).join(df, "token", "left")
    index = filed.groupBy("rule_id").agg(
        F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), "token")).alias("token"), F.first("tokens").alias("needs")
    )
    index = cut(index, "rule-index")
    looked = pages.select("page", "tokens", F.explode("tokens").alias("token"))
    found = looked.join(index, "token")
    return found.where(F.size(F.array_except("needs", "tokens")) == 0).select("page", "rule_id")


def judged(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", **how) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule): listed rules first, then mined ones; else allow."""
    parsed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url__")).select(
        "page_id", *[c.alias(n) for c, n in zip(split_url(F.col("url__")), ("host", "path"), strict=True)]
    )
    parsed = parsed.withColumn("tokens", tokens(F.col("host"), F.col("path")))
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    marked = cut(parsed.join(told, parsed["page_id"] == told["doc_id"]).select("tokens", "bad"), "url-labels")
    rules = mine(marked, **how)
    keyed = cut(parsed.withColumn("page", F.monotonically_increasing_id()), "urls")
    hits = match(keyed, rules, rarity(marked)).join(rules.select("rule_id", "confidence", F.array_join("tokens", " ").alias("t")), "rule_id")
    best = hits.groupBy("page").agg(F.max_by("t", F.struct("confidence", "t")).alias("mined_rule"))
    rule, verdict = listed(F.col("host"), F.col("path"))
    out = keyed.join(best, "page", "left")
    mined = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "mined_rule")


def op5_url_rules(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return judged(pages, labels)
