"""Operational aggregates and ordered folds over event tables: limits, budgets, experiments, history, queues, merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def rate_limit(calls: DataFrame, period_ms: int, most: int) -> DataFrame:
    """calls (key, seq, ts, cost) with allowed, remaining and retry_ms, by one theoretical arrival time a key.

    Whether a call passes depends on all before it, so a key's calls are folded in order in one task.
    """
    interval = period_ms / most

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "seq"])
        tat, out = float("-inf"), []
        for now, cost in zip(frame["ts"], frame["cost"], strict=True):
            new = max(tat, now) + interval * max(cost, 1)
            wait = new - period_ms - now
            if wait > 0:
                out.append((False, 0, int(wait)))
            else:
                tat = new
                out.append((True, max(0, int((period_ms - (new - now)) // interval)), 0))
        frame[["allowed", "remaining", "retry_ms"]] = pd.DataFrame(out, index=frame.index)
        return frame

    return calls.groupBy("key").applyInPandas(run, "key long, seq long, ts long, cost long, allowed boolean, remaining long, retry_ms long")


def circuit(outcomes: DataFrame, window: int = 20, threshold: float = 0.5, least: int = 10, cooldown_ms: int = 30_000, probes: int = 1) -> DataFrame:
    """outcomes (service, seq, ts, ok) with the breaker's state after each: closed, open or half-open."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "seq"])
        state, ring, opened, passed, states = "closed", [], 0, 0, []
        for ts, ok in zip(frame["ts"], frame["ok"], strict=True):
            if state == "open" and ts - opened >= cooldown_ms:
                state, passed = "half-open", 0
            if state == "half-open":
                if not ok:
                    state, opened = "open", ts
                else:
                    passed += 1
                    if passed >= probes:
                        state, ring = "closed", []
            elif state == "closed":
                ring = [*ring, ok][-window:]
                if len(ring) >= least and ring.count(False) / len(ring) >= threshold:
                    state, opened = "open", ts
            states.append(state)
        frame["state"] = states
        return frame

    return outcomes.groupBy("service").applyInPandas(run, "service string, seq long, ts long, ok boolean, state string")


def budget_fit(charges: DataFrame, most: float) -> DataFrame:
    """charges (key, seq, cost) with accepted: a charge counts only if it still fits, and later smaller ones may."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        used, out = 0.0, []
        for cost in frame["cost"]:
            fits = used + cost <= most
            used += cost if fits else 0
            out.append(fits)
        frame["accepted"] = out
        return frame

    return charges.groupBy("key").applyInPandas(run, "key long, seq long, cost double, accepted boolean")


def sliding_usage(charges: DataFrame, window_ms: int) -> DataFrame:
    """charges (key, ts, cost) with what the window up to each has cost."""
    w = Window.partitionBy("key").orderBy("ts").rangeBetween(-window_ms, 0)
    return charges.withColumn("used", F.sum("cost").over(w))


def as_of(history: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (key, ts, …) with the latest value of history (key, ts, value) at or before each.

    One union and one window by key: no pair of versions and asks is made.
    """
    other = [c for c in asks.columns if c not in ("key", "ts")]
    both = history.select("key", "ts", "value", F.lit(0).alias("ask__"), *[F.lit(None).cast(asks.schema[c].dataType).alias(c) for c in other]).unionByName(
        asks.select("key", "ts", F.lit(None).cast(history.schema["value"].dataType).alias("value"), F.lit(1).alias("ask__"), *other)
    )
    w = Window.partitionBy("key").orderBy("ts", "ask__").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("value", F.last("value", ignorenulls=True).over(w)).where("ask__ = 1").drop("ask__")


def percentiles(samples: DataFrame, by: str, points: list[float]) -> DataFrame:
    """Exact percentiles p<n> of value: element number int(n * p), by rank and not by collecting a key's samples."""
    w = Window.partitionBy(by)
    ranked = samples.select(by, "value", (F.row_number().over(w.orderBy("value")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    at = lambda p: F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    return ranked.groupBy(by).agg(*[F.max(F.when(F.col("i") == at(p), F.col("value"))).alias(f"p{round(p * 100)}") for p in points])


def histogram(samples: DataFrame, by: str) -> DataFrame:
    """Counts by the next power of two, 1 at least."""
    bucket = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("value", F.lit(1.0))))).cast("long")
    return samples.groupBy(by, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def experiment(exposures: DataFrame, outcomes: DataFrame, least: int = 30) -> DataFrame:
    """(variant, exposures, wins, win_rate, avg_value, leader): the best rate leads if it has enough exposures."""
    seen = exposures.groupBy("variant").agg(F.count("*").alias("exposures"))
    won = outcomes.groupBy("variant").agg(F.count("*").alias("wins"), F.sum("value").alias("total"))
    out = seen.join(won, "variant", "left").select(
        "variant", "exposures", F.coalesce("wins", F.lit(0)).alias("wins"),
        (F.coalesce("wins", F.lit(0)) / F.col("exposures")).alias("win_rate"),
        F.coalesce(F.col("total") / F.col("wins"), F.lit(0.0)).alias("avg_value"),
    )
    best = F.row_number().over(Window.orderBy(F.desc("win_rate"), "variant")) == 1  # one row a variant
    return out.withColumn("leader", best & (F.col("exposures") >= least))


def hash_share(name: str, user: Column) -> Column:
    """A number in [0, 1) that a name and a user always share."""
    return F.pmod(F.xxhash64(F.lit(name), user), F.lit(1 << 30)) / float(1 << 30)


def assign(name: str, user: Column, weights: dict[str, float]) -> Column:
    """Sticky variant by cumulative weights."""
    total, upto, out = sum(weights.values()), 0.0, None
    share = hash_share(name, user)
    for variant, weight in weights.items():
        upto += weight / total
        out = F.when(share < upto, variant) if out is None else out.when(share < upto, variant)
    return out.otherwise(list(weights)[-1])


def flag(user: Column, name: str, deny: list, allow: list, percent: float, default: bool = False) -> Column:
    """Deny goes before allow, allow before the percentage."""
    return F.when(user.isin(deny), False).when(user.isin(allow), True).when(hash_share(name, user) * 100 < percent, True).otherwise(default)


def audit(log: DataFrame, limit: int, **wanted) -> DataFrame:
    for name, value in wanted.items():
        log = log.where(F.col(name) == value)
    return log.orderBy(F.desc("id")).limit(limit)


def spans(events: DataFrame) -> DataFrame:
    """Starts and ends (span, kind, ts) as (span, start, duration)."""
    ends = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("ts")))
    return events.groupBy("span").agg(ends("start").alias("start"), (ends("end") - ends("start")).alias("duration"))


def queue_order(jobs: DataFrame, now: int, limit: int) -> DataFrame:
    """Visible jobs by priority, then id."""
    return jobs.where(F.col("visible_at") <= now).orderBy(F.desc("priority"), "id").limit(limit)


def queue_fold(log: DataFrame, attempts: int) -> DataFrame:
    """Last state of each job in a log (id, seq, op): done after an ack, dead after so many nacks, else ready."""
    ops = log.groupBy("id").agg(F.bool_or(F.col("op") == "ack").alias("acked"), F.count_if(F.col("op") == "nack").alias("nacks"))
    return ops.select("id", "nacks", F.when(F.col("acked"), "done").when(F.col("nacks") >= attempts, "dead").otherwise("ready").alias("state"))


def compensations(steps: DataFrame) -> DataFrame:
    """steps (saga, step, comp, status): for failed sagas, compensations from the last step back."""
    failed = steps.where("status = 'failed'").select("saga").distinct()
    done = steps.join(failed, "saga", "left_semi").where("comp is not null and comp <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("step", "comp")))
    return done.groupBy("saga").agg(F.reverse(F.transform(ordered, lambda x: x["comp"])).alias("undo"))


def g_counter(replicas: DataFrame) -> DataFrame:
    """Merged counter of (key, actor, n): each actor's largest count, summed."""
    return replicas.groupBy("key", "actor").agg(F.max("n").alias("n")).groupBy("key").agg(F.sum("n").alias("value"))


def pn_counter(replicas: DataFrame) -> DataFrame:
    each = replicas.groupBy("key", "actor").agg(F.max("up").alias("up"), F.max("down").alias("down"))
    return each.groupBy("key").agg((F.sum("up") - F.sum("down")).alias("value"))


def lww(replicas: DataFrame) -> DataFrame:
    """The value with the latest (ts, actor)."""
    return replicas.groupBy("key").agg(F.max_by("value", F.struct("ts", "actor")).alias("value"))


def or_set(replicas: DataFrame) -> DataFrame:
    """Members that any replica holds a tag of; no tombstones are kept."""
    return replicas.select("key", "member", "tag").distinct().groupBy("key", "member").agg(F.count("*").alias("tags"))


def lineage(edges: DataFrame, node, upstream: bool = True) -> DataFrame:
    here, there = ("output", "source") if upstream else ("source", "output")
    return edges.where(F.col(here) == node).select(F.col(there).alias("node")).distinct()


def first_per_window(calls: DataFrame, window_ms: int) -> DataFrame:
    """The first call of each key and window (key, ts, seq)."""
    i = F.row_number().over(Window.partitionBy("key", F.floor(F.col("ts") / window_ms)).orderBy("ts", "seq"))
    return calls.withColumn("i", i).where("i = 1").drop("i")


def first_healthy(ladder: DataFrame) -> DataFrame:
    """The first healthy provider of each model (model, pos, provider, healthy)."""
    return ladder.where("healthy").groupBy("model").agg(F.min_by("provider", "pos").alias("provider"))


def stop_reason(steps: DataFrame, caps: dict[str, float]) -> DataFrame:
    """steps (loop, step, …): the first step at which a running sum passes its cap, and which."""
    w = Window.partitionBy("loop").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    over = F.coalesce(*[F.when(F.sum(c).over(w) > cap, F.lit(c)) for c, cap in caps.items()])
    return steps.withColumn("reason", over).where("reason is not null").groupBy("loop").agg(F.min("step").alias("step"), F.min_by("reason", "step").alias("reason"))


def hit_rate(lookups: DataFrame, by: str) -> DataFrame:
    """lookups (by, hit): hits over lookups."""
    return lookups.groupBy(by).agg(F.avg(F.col("hit").cast("double")).alias("rate"), F.count("*").alias("n"))


def memo(lookups: DataFrame, cache: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """lookups with the cached value that is still fresh, and whether there is one."""
    fresh = cache.where(F.col("expire_ms").isNull() | (F.col("expire_ms") > now)).select(*keys, "value")
    return lookups.join(fresh, keys, "left").withColumn("hit", F.col("value").isNotNull())


def tool_key(tool: Column, args: Column) -> Column:
    """A call's key: the tool, and the members of its JSON arguments by name, nested values as they stand."""
    members = F.array_sort(F.map_entries(F.from_json(args, "map<string,string>")))
    return F.concat_ws("|", tool, F.array_join(F.transform(members, lambda m: F.concat(m["key"], F.lit("="), F.coalesce(m["value"], F.lit("null")))), ","))


def slo(samples: DataFrame, by: str, p: float, most: float) -> DataFrame:
    """Whether each key's percentile keeps its target."""
    found = percentiles(samples, by, [p]).withColumnRenamed(f"p{round(p * 100)}", "value")
    return found.withColumn("ok", F.col("value") <= most)
