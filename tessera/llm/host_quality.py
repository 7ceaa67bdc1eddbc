"""Host-level quality rules with empirical-Bayes shrinkage.

Every document gets exact counts over its whole text and a set of rule failures. The failures of every rule, base and
soft, are aggregated by host (the source column), and each rate is shrunk towards its rule's beta prior, fitted to all
hosts by moments. A host is bad if one of its shrunk rates is above BAD_HOST_SDS standard deviations of the prior over
the prior's mean, or above BAD_HOST_RATE. The host's verdict is joined back: a document of a bad host must fail no rule
at all, any other document must only pass the base rules. So a clean document is kept whatever its host.

Nulls and empty texts have no words and fail the base rule. A null source is a host of its own. Repeated rows count as
often as they occur. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import cut

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Softer rules, which only count against documents of bad hosts.
SOFT = {"symbols": 0.1, "dup_lines": 0.3, "short_mean": 2.0, "long_mean": 20.0}
BAD_HOST_RATE = 0.5
BAD_HOST_SDS = 2.0

_SPACE = b" \t\n\x0b\x0c\r"
_NOT_STARTS = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, first occurrences included.

    Window identities are exact: ids of pairs, then of pairs of pairs, so no hash can collide.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    if len(seen) == len(words):
        return 0
    span = 1
    while span < width:
        step = min(span, width - span)
        base = int(ids.max()) + 1
        ids = ids[: len(ids) - step] * base + ids[step:]
        _, ids, counts = np.unique(ids, return_inverse=True, return_counts=True)
        span += step
        if counts.max(initial=1) < 2:
            return 0
    starts = np.flatnonzero(counts[ids] > 1)
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    cover[starts] += 1
    cover[starts + width] -= 1
    return int((np.cumsum(cover) > 0).sum())


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """COUNTS of a whole UTF-8 text."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, _SPACE + _NOT_STARTS)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def counted(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and COUNTS for every row."""
    rows = docs.select(*keys, F.col(text_col).alias("text__"))
    return _counted(rows, lambda batch: batch.column(len(keys))).drop("text__")


def _counted(rows: DataFrame, texts) -> DataFrame:
    """rows and COUNTS; texts picks the text column of a batch."""
    names = rows.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"{c} long" for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_counts(x.as_py()) for x in texts(batch).cast(pa.binary())]
            found = np.array(found, dtype=np.int64).reshape(-1, len(COUNTS))
            arrays = [*batch.columns, *(pa.array(found[:, i].copy()) for i in range(len(COUNTS)))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *COUNTS])

    return rows.mapInArrow(run, schema)


def base_rules() -> dict[str, F.Column]:
    return {
        "few_words": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
    }


def soft_rules() -> dict[str, F.Column]:
    mean = F.col("word_chars") / F.greatest("n_words", F.lit(1))
    return {
        "symbols": F.col("n_symbols") > SOFT["symbols"] * F.col("n_words"),
        "dup_lines": F.col("n_dup_lines") > SOFT["dup_lines"] * F.col("n_lines"),
        "short_mean": mean < SOFT["short_mean"],
        "long_mean": mean > SOFT["long_mean"],
    }


def _any(rules: dict[str, F.Column]) -> F.Column:
    return reduce(or_, rules.values())


def base_failed() -> F.Column:
    return _any(base_rules())


def soft_failed() -> F.Column:
    return _any(soft_rules())


def host_rates(marked: DataFrame, host_col: str) -> DataFrame:
    """(host, n_docs, n_failed, rate, host_bad) of rows with COUNTS; n_failed and rate are of documents that fail any rule.

    The priors are one row, fitted to all hosts by moments, each rule on its own.
    """
    rules = base_rules() | soft_rules()
    rules["any"] = _any(rules)
    hosts = marked.groupBy(F.col(host_col).alias("host")).agg(
        F.count("*").alias("n_docs"), *[F.sum(failed.cast("long")).alias(f"f_{k}") for k, failed in rules.items()]
    )
    fitted = hosts.agg(
        F.avg(1 / F.col("n_docs")).alias("per"),
        *[(F.sum(f"f_{k}") / F.sum("n_docs")).alias(f"m_{k}") for k in rules],
        *[F.var_pop(F.col(f"f_{k}") / F.col("n_docs")).alias(f"v_{k}") for k in rules],
    )
    strengths = []
    for k in rules:
        spread = F.col(f"m_{k}") * (1 - F.col(f"m_{k}"))
        between = F.greatest(F.col(f"v_{k}") - spread * F.col("per"), F.lit(1e-6))
        strengths.append(F.least(F.greatest(spread / between - 1, F.lit(2.0)), F.lit(1e6)).alias(f"s_{k}"))
    prior = fitted.select(*[f"m_{k}" for k in rules], *strengths)

    def rate(k: str) -> F.Column:
        return (F.col(f"f_{k}") + F.col(f"m_{k}") * F.col(f"s_{k}")) / (F.col("n_docs") + F.col(f"s_{k}"))

    def limit(k: str) -> F.Column:
        sd = F.sqrt(F.col(f"m_{k}") * (1 - F.col(f"m_{k}")) / (F.col(f"s_{k}") + 1))
        return F.least(F.col(f"m_{k}") + BAD_HOST_SDS * sd, F.lit(BAD_HOST_RATE))

    bad = reduce(or_, [rate(k) > limit(k) for k in rules if k != "any"])
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", F.col("f_any").alias("n_failed"), rate("any").alias("rate"), bad.alias("host_bad"))


def judged(docs: DataFrame, keys: list[str], host_col: str = "source", text_col: str = "text") -> DataFrame:
    """keys, COUNTS, base_failed, soft_failed, host_rate and kept for every row.

    The host table is written, so its size is known: Spark broadcasts it below its threshold and otherwise joins by
    sort-merge, where adaptive execution splits a hot host.
    """
    keys = list(dict.fromkeys([*keys, host_col]))
    marked = counted(docs, keys, text_col).withColumn("base_failed", base_failed()).withColumn("soft_failed", soft_failed())
    marked = cut(marked, "quality")
    hosts = cut(host_rates(marked, host_col), "hosts")
    bad = F.coalesce("host_bad", F.lit(False))
    joined = marked.join(hosts, marked[host_col].eqNullSafe(hosts["host"]), "left")
    kept = ~F.col("base_failed") & ~(bad & F.col("soft_failed"))
    return joined.select(*[marked[c] for c in marked.columns], F.col("rate").alias("host_rate"), kept.alias("kept"))


def keep_good(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their columns.

    Counts are made twice, for the hosts' rates and beside the rows themselves, so that no text is written; the host
    table travels to the documents where it is below Spark's broadcast threshold.
    """
    hosts = cut(host_rates(counted(docs, [host_col], text_col), host_col), "hosts")
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[host_col].alias("host_of"))
    at = docs.columns.index(text_col)
    kept = _counted(held, lambda batch: batch.column(0).flatten()[at]).where(~base_failed())
    joined = kept.join(hosts.where("host_bad"), kept["host_of"].eqNullSafe(hosts["host"]), "left")
    return joined.where(~(soft_failed() & F.coalesce("host_bad", F.lit(False)))).select("row.*")


def op4_host_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return judged(docs, ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate"
    )
