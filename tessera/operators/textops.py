"""Text functions for prompts and answers: sizes, chunks, redaction, scans, grounding, consensus and grading."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import count_of, jaccard, plain_tokens

# Token multipliers by model family, the first prefix that fits; others 1.
FAMILIES = [
    ("gpt-4o", 1.00), ("gpt-4", 1.05), ("gpt-3.5", 1.05), ("o1", 1.00), ("o3", 1.00), ("o4", 1.00),
    ("claude", 1.10), ("llama", 1.15), ("mistral", 1.15), ("mixtral", 1.15),
]
SOFT_PUNCTUATION = "!?.,;:-_()[]{}\"'`"
# Patterns that are redacted, in order, with their placeholders' names.
REDACTIONS = [
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "EMAIL"),
    ("phone-us", r"(?:\+?1[-. ]?)?\(?[2-9]\d{2}\)?[-. ]?\d{3}[-. ]?\d{4}", "PHONE"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "SSN"),
    ("credit-card", r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6011)[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", "CARD"),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "IP"),
    ("api-key", r"\b(?:sk-[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,})\b", "APIKEY"),
]
# Signs of prompt injection, in order, with their severity.
INJECTIONS = [
    ("ignore-previous", r"(?i)ignore (all |everything )?(previous|prior|the (above|prior)) (instruction|message|prompt|rule|context)s?", 1.0),
    ("role-flip", r"(?i)\b(you are now|act as|pretend to be|roleplay as|simulate (a|an)) (a|an) ?[a-z][a-z\- ]{2,}", 0.9),
    ("system-prompt-leak", r"(?i)(reveal|show|print|repeat|output) (your|the) (system|initial|hidden) (prompt|instructions|message)", 0.9),
    ("dan-jailbreak", r"(?i)\b(DAN|do anything now|developer mode enabled|jailbroken|unfiltered mode)\b", 0.95),
    ("instruction-override", r"(?i)(disregard|forget|override) (all|every|your) (rules|guidelines|instructions|safety)", 1.0),
    ("encoded-payload", r"(?i)(base64|rot13|hex)[\s:-]+[A-Za-z0-9+/=]{40,}", 0.5),
    ("delimiter", r"(?i)\[/?(SYSTEM|USER|INST|ASSISTANT)\]|<\|/?(im_start|im_end|system|user)\|>", 0.8),
]
CITATION = r"\[(\d+|[A-Za-z][A-Za-z0-9_-]*)\]"
GROUND_OK, GROUND_BAD = 0.45, 0.15


def multiplier(model: str) -> float:
    return next((m for prefix, m in FAMILIES if model.lower().startswith(prefix)), 1.0)


def token_count(text: Column, model: str = "") -> Column:
    """Estimated tokens: bytes over a divisor that white space raises and punctuation lowers, times the family's rate."""
    size = F.octet_length(text)
    blank, marks = count_of(text, " \t\n\r") / size, count_of(text, SOFT_PUNCTUATION) / size
    base = size / F.greatest(F.lit(2.5), 4.0 + blank * 0.6 - marks * 0.5)
    return F.when(size > 0, F.greatest(F.floor(base * multiplier(model) + 0.5), F.lit(1))).otherwise(0).cast("long")


def token_split(model: str, limit: int):
    """UDF: pieces of at most some estimated tokens, cut at the last white space that fits."""
    size = max(1, int(limit * 4.0 / multiplier(model)))

    def one(text: str | None) -> list[str] | None:
        if text is None:
            return None
        raw, out = text.encode(), []
        while raw:
            if len(raw) <= size:
                out.append(raw.decode(errors="ignore"))
                break
            at = max(raw[:size].rfind(b) for b in (b" ", b"\t", b"\n"))
            at = at if at > 0 else size
            out.append(raw[:at].rstrip(b" \t\n").decode(errors="ignore"))
            raw = raw[at:].lstrip(b" \t\n")
        return out

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run


def chunk_chars(text: Column, size: int = 1024, overlap: int = 0) -> Column:
    """Windows of size characters, each overlapping the one before; the last ends with the text."""
    overlap = size // 2 if overlap >= size else overlap
    step, n = size - overlap, F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))
    return F.when(n > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Parts that end with ., ! or ? before white space, or at a line's end."""
    marked = F.regexp_replace(text, r"([.!?])(\s)", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), F.trim), lambda s: s != "")


def redaction_counts(text: Column) -> Column:
    """Struct of matches by pattern; each pattern sees what the ones before left."""
    out, rest = [], text
    for name, pattern, label in REDACTIONS:
        out.append(F.regexp_count(rest, F.lit(pattern)).alias(name.replace("-", "_")))
        rest = F.regexp_replace(rest, pattern, f"<{label}>")
    return F.struct(*out)


def redact():
    """UDF: text with numbered placeholders and what they stand for."""
    import re

    compiled = [(re.compile(p), label) for _, p, label in REDACTIONS]

    def one(text: str | None):
        if text is None:
            return None
        originals = {}
        for pattern, label in compiled:
            n = 0

            def put(m, label=label):
                nonlocal n
                n += 1
                originals[f"<{label}_{n}>"] = m.group(0)
                return f"<{label}_{n}>"

            text = pattern.sub(put, text)
        return {"text": text, "originals": originals}

    @F.pandas_udf("text string, originals map<string,string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [one(t) or {"text": None, "originals": None} for t in texts]
        return pd.DataFrame({"text": [f["text"] for f in found], "originals": [f["originals"] for f in found]})

    return run


def restore(text: Column, originals: Column) -> Column:
    return F.aggregate(F.map_entries(originals), text, lambda t, e: F.replace(t, e["key"], e["value"]))


def injection(text: Column) -> Column:
    """Name of the first sign that matches; null without one."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(n)) for n, p, _ in INJECTIONS])


def injections(text: Column) -> Column:
    """All signs that match."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p, _ in INJECTIONS]), lambda n: n.isNotNull())


def injection_severity(text: Column) -> Column:
    return F.greatest(*[F.when(text.rlike(p), F.lit(s)).otherwise(0.0) for _, p, s in INJECTIONS])


def canonical(text: Column) -> Column:
    """Lower case, urls as U, digit runs as D, soft punctuation dropped, white space as one blank."""
    out = F.regexp_replace(text, r"(?<!\S)https?://\S*", "\u0001")
    out = F.translate(F.regexp_replace(F.lower(out), r"[0-9]+", "\u0002"), SOFT_PUNCTUATION, "")
    out = F.regexp_replace(out, r"\s+", " ")
    return F.trim(F.translate(out, "\u0001\u0002", "UD"))


def fingerprint(text: Column) -> Column:
    return F.lower(F.hex(F.xxhash64(canonical(text))))


def ngrams(text: Column) -> Column:
    """Distinct words and word pairs."""
    t = plain_tokens(text)
    pairs = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(t, pairs))


def ground(outputs: DataFrame, sources: DataFrame, ok: float = GROUND_OK, bad: float = GROUND_BAD) -> DataFrame:
    """outputs (id, text), sources (id, source): (id, score, verdict); a text is as grounded as its worst claim."""
    claims = outputs.select("id", F.posexplode_outer(sentences(F.col("text"))).alias("pos", "claim")).withColumn("bag", ngrams(F.col("claim")))
    bags = sources.select("id", ngrams(F.col("source")).alias("source_bag"))
    best = claims.join(bags, "id", "left").groupBy("id", "pos").agg(
        F.max(F.when(F.col("claim").isNull(), 1.0).when(F.col("source_bag").isNull(), 0.0).otherwise(jaccard(F.col("bag"), F.col("source_bag")))).alias("s")
    )
    out = best.groupBy("id").agg(F.min("s").alias("score"))
    return out.withColumn("verdict", F.when(F.col("score") >= ok, "accept").when(F.col("score") < bad, "reject").otherwise("gray"))


def consensus_exact(samples: DataFrame) -> DataFrame:
    """samples (query, sample): the most frequent trimmed answer, its share, and how many answers there are."""
    counted = samples.groupBy("query", F.trim("sample").alias("answer")).agg(F.count("*").alias("n"))
    return counted.groupBy("query").agg(
        F.max_by("answer", F.struct(F.col("n"), F.col("answer"))).alias("chosen"), (F.max("n") / F.sum("n")).alias("confidence"), F.count("*").alias("buckets")
    )


def consensus_medoid(samples: DataFrame) -> DataFrame:
    """The sample most like the others of its query, by mean Jaccard of words; samples (query, pos, sample)."""
    t = samples.select("query", "pos", "sample", F.array_distinct(plain_tokens(F.col("sample"))).alias("bag"))
    other = t.select("query", F.col("pos").alias("pos2"), F.col("bag").alias("bag2"))
    scored = t.join(other, "query").where("pos <> pos2").groupBy("query", "pos", "sample").agg(F.avg(jaccard(F.col("bag"), F.col("bag2"))).alias("mean"))
    return scored.groupBy("query").agg(F.max_by("sample", F.struct(F.col("mean"), -F.col("pos"))).alias("chosen"), F.max("mean").alias("confidence"))


def grade(expected: Column, actual: Column, grader: Column, tolerance: Column) -> Column:
    """Whether an answer passes: exact, contains, regex or numeric_within."""
    number = lambda c: F.regexp_extract(c, r"-?\d+\.?\d*", 0).try_cast("double")
    return (
        F.when(grader == "exact", F.trim(actual) == F.trim(expected))
        .when(grader == "contains", F.contains(F.lower(actual), F.lower(expected)))
        .when(grader == "regex", F.regexp_like(actual, expected))
        .when(grader == "numeric_within", F.abs(number(actual) - number(expected)) <= tolerance)
    )


def pass_rate(runs: DataFrame, last: int) -> DataFrame:
    """runs (prompt, ts, pass): share of the last runs that pass."""
    recent = runs.withColumn("i", F.row_number().over(Window.partitionBy("prompt").orderBy(F.desc("ts"))))
    return recent.where(F.col("i") <= last).groupBy("prompt").agg(F.avg(F.col("pass").cast("double")).alias("rate"), F.count("*").alias("n"))


def conversation_window(turns: DataFrame, budget: int) -> DataFrame:
    """The newest turns (conv, turn, text) that fit a budget of quarter bytes, one at least."""
    tokens = F.ceil(F.octet_length("text") / 4)
    w = Window.partitionBy("conv").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    newest = turns.withColumn("used", F.sum(tokens).over(w)).withColumn("i", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("turn"))))
    return newest.where((F.col("used") <= budget) | (F.col("i") == 1)).drop("i")


def shrink_white_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def citations(text: Column) -> Column:
    """Labels of citation marks, in order."""
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))


def citation_check(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answers (id, text), sources (id, label): every mark with whether a source has it."""
    marks = answers.select("id", F.posexplode(citations(F.col("text"))).alias("pos", "label"))
    known = sources.select("id", "label").distinct().withColumn("valid", F.lit(True))
    return marks.join(known, ["id", "label"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def render(body: Column, variables: Column) -> Column:
    """{name} replaced by its value; unknown names stay."""
    return F.aggregate(F.map_entries(variables), body, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def assemble(sections: DataFrame, budget: int) -> DataFrame:
    """sections (ctx, pos, priority, tokens): by priority, then place, those that still fit; what doesn't fit is passed over.

    Which sections fit depends on those before, so a context is folded as one ordered array.
    """
    ordered = sections.groupBy("ctx").agg(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "pos", "tokens"))).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("kept"))
    step = lambda acc, x: F.when(
        acc["used"] + x["tokens"] <= budget,
        F.struct((acc["used"] + x["tokens"]).alias("used"), F.concat(acc["kept"], F.array(x["pos"].cast("long"))).alias("kept")),
    ).otherwise(acc)
    return ordered.select("ctx", F.aggregate("s", start, step).alias("r")).select("ctx", "r.used", F.array_sort("r.kept").alias("kept"))


def guardrail(text: Column, severity: float, max_bytes: int, blocked: str) -> Column:
    """Name of the first stage that a text fails, else pass."""
    return F.coalesce(
        F.when(injection_severity(text) >= severity, "inject"),
        F.when(F.octet_length(text) > max_bytes, "length"),
        F.when(text.rlike(blocked), "regex_block"),
        F.lit("pass"),
    )
