"""Near-duplicates by the exact Jaccard similarity of word shingles.

Two texts are linked if their sets of shingles (runs of five words, in lower case) have a similarity of 0.8 or more;
linked texts form groups. Texts with equal sets are collapsed first. Shingles are held as 64-bit hashes.

Candidates come from operator 1: fingerprints of the same shingles go through its grid range join, and what it links is
verified by the exact similarity. Texts of similarity 0.8 differ in more bits than it links, so MinHash bands as in operator
8 propose the rest: one hash a shingle, BINS bins, nine bands of three bins, so such texts share a band with a probability of
0.993 (by simulation; tests compare with all pairs). Buckets of a few texts are expanded into all pairs, larger ones not
at first: each text meets the bucket's first and its neighbour, and after union-find the heads of the bucket's components
meet, until a round adds few links. All pairs of a bucket's texts of different components settle the rest, so no two
similar texts that share a bucket stay apart. Candidates are verified by the exact similarity; sets' sizes and sketches,
as in operator 8, spare only pairs that can't have it.

A text of fewer words than a shingle is one shingle; nulls and texts without words have the empty set and are one group.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.graph_components import connected_components
from tessera.llm.line_dedup import BINS, FEW, SMALL, WORDS, band_keys, bucket_pairs, may_reach, mixed_pairs, other_pairs, side
from tessera.storage import cut, drop, release

WIDTH = 5
THRESHOLD = 0.8
MARKS = ("n", *[f"x{k}" for k in range(WORDS)])


def shingle_hashes(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Unsigned hashes of a whole UTF-8 text's shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    joined = b" ".join(words)
    starts = list(accumulate(map(len, words), lambda p, n: p + n + 1, initial=0))
    digest = xxhash.xxh64_intdigest
    found = (digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[width:], strict=False))
    return np.fromiter(found, dtype=np.uint64, count=len(words) - width + 1)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of a whole UTF-8 text's shingles, in ascending order."""
    return np.unique(shingle_hashes(text, width).view(np.int64))


def set_id(found: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(found.tobytes()), np.uint64).view(np.int64))


def signature(found: np.ndarray) -> list[int] | None:
    """Least value of each bin, an empty one with the next one's; None for the empty set."""
    if not len(found):
        return None
    h = found.view(np.uint64)
    keyed = np.sort((h & np.uint64(0xFFFFF)) % np.uint64(BINS) << np.uint64(31) | h >> np.uint64(33))
    bins, at = np.unique(keyed >> np.uint64(31), return_index=True)
    values = (keyed[at] & np.uint64(0x7FFFFFFF)).astype(np.int64)
    return values[np.searchsorted(bins, np.arange(BINS, dtype=np.uint64)) % len(bins)].tolist()


def sketch(found: np.ndarray) -> np.ndarray:
    """The parity of a set's hashes in each of 64 * WORDS cells, as WORDS longs."""
    h = found.view(np.uint64)
    cells = (h & np.uint64(WORDS - 1)) * np.uint64(64) + (h >> np.uint64(5) & np.uint64(63))
    odd = np.bincount(cells.astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """texts (doc_id, text) to (id, s): id names the set s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x.as_py(), width) for x in batch.column(1)]
            ids = pa.array([set_id(s) for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.list_(pa.int64()))], names=["id", "s"])

    return texts.mapInArrow(run, "id long, s array<long>")


def marked(texts: DataFrame, width: int) -> DataFrame:
    """texts (doc_id, text) to (doc_id, body, id, bins, fp, n, x0, x1, ...): the text's hash, its set's name and signature, operator 1's fingerprint, the set's size and sketch."""
    from tessera.llm.simhash import fingerprint_of, signed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [shingle_hashes(x.as_py(), width) for x in batch.column(2)]
            found = [np.unique(x.view(np.int64)) for x in every]
            fps = pa.array([signed(fingerprint_of(x)) for x in every], pa.int64())
            ids, bins = pa.array([set_id(s) for s in found], pa.int64()), pa.array([signature(s) for s in found], pa.list_(pa.int32()))
            sizes = pa.array([len(s) for s in found], pa.int64())
            words = np.stack([sketch(s) for s in found]) if found else np.zeros((0, WORDS), np.int64)
            columns = [batch.column(0), batch.column(1), ids, bins, fps, sizes, *[pa.array(words[:, k]) for k in range(WORDS)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "body", "id", "bins", "fp", *MARKS])

    rows = texts.select("doc_id", F.xxhash64("text").alias("body"), "text")
    return rows.mapInArrow(run, "doc_id long, body long, id long, bins array<int>, fp long, " + ", ".join(f"{c} long" for c in MARKS))


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """nodes (id, fp) to candidate pairs (a, b): what operator 1's grid range join links; sets of one fingerprint meet its least."""
    from tessera.llm.simhash import link_edges

    least = cut(nodes.groupBy("fp").agg(F.min("id").alias("first")), "near-fps")
    of = lambda x: least.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_id"))
    across = link_edges(least.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    same = nodes.join(least, "fp").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return across.union(same).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """pairs (a, b) of set names whose exact similarity reaches the threshold; nodes (id, doc_id, n, x0, ...) name a text of each.

    Pairs whose sketches rule it out are spared the exact look.
    """
    marks = nodes.withColumnRenamed("id", "k1")
    pairs = cut(pairs.join(side(marks, "a"), "a").join(side(marks, "b"), "b").where(may_reach(threshold)).select("a", "b"), "near-asked")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    asked = nodes.join(ids, "id", "left_semi").select("doc_id").distinct()
    some = texts.join(asked, texts["doc_id"].eqNullSafe(asked["doc_id"]), "left_semi")
    sets = cut(sets_of(some, width).join(ids, "id", "left_semi").dropDuplicates(["id"]), "near-sets")
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    enough = F.size(F.array_intersect("sa", "sb")) * (1 + threshold) >= (F.size("sa") + F.size("sb")) * threshold - 1e-9
    links = cut(pairs.join(left, "a").join(right, "b").where(enough).select("a", "b"), "near-links")
    drop(sets, pairs)
    return links


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, body, component_id, root): component_id is the smallest doc_id reachable over links, root names the group."""
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    each = cut(marked(texts, width), "near-marked")
    nodes = cut(each.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("bins").alias("bins"), F.min("fp").alias("fp"), *[F.first(c).alias(c) for c in MARKS]), "near-nodes")
    keys = band_keys(nodes.where("bins is not null").select(F.col("id").alias("k1"), "bins"))
    sizes = cut(keys.groupBy("key").agg(F.count("*").alias("size"), F.min("k1").alias("first")).where("size > 1"), "near-sizes")
    met = cut(keys.join(sizes, "key"), "near-buckets")
    tried = [cut(fingerprint_pairs(nodes.where("bins is not null")).union(bucket_pairs(met, SMALL - 1)).distinct(), "near-pairs")]
    links = verified(tried[0], nodes, texts, width, threshold)
    roots = connected_components(links)
    release(spark)
    large = cut(met.where(F.col("size") > SMALL), "near-buckets")
    if not large.isEmpty():
        links, roots = large_buckets(large, nodes, texts, tried, links, roots, width, threshold)
    rooted = nodes.join(roots, nodes["id"] == roots["node"], "left").select("id", "doc_id", F.coalesce("root", "id").alias("root"))
    rooted = cut(rooted, "near-rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = cut(rooted.join(least, "root").select("id", "root", "component_id"), "near-classes")
    drop(nodes, sizes, met, large, links, rooted, *tried)
    release(spark)
    return each.join(found, "id").select("doc_id", "body", "component_id", "root")


def large_buckets(
    met: DataFrame, nodes: DataFrame, texts: DataFrame, tried: list[DataFrame], links: DataFrame, roots: DataFrame, width: int, threshold: float
) -> tuple[DataFrame, DataFrame]:
    """links and roots with what rounds of heads, then all pairs of different components add in the buckets of met."""
    n_links = links.count()
    named = lambda: roots.select(F.col("node").alias("k1"), "root")
    rounds = True
    while rounds:
        more = cut(mixed_pairs(met, named(), tried), "near-pairs")
        tried.append(more)
        found = verified(more, nodes, texts, width, threshold)
        n_found = found.count()
        n_links += n_found
        rounds = n_found > FEW * n_links
        if n_found:
            links = cut(links.union(found), "near-links")
            roots = connected_components(links)
        drop(found)
    tried.append(other_pairs(met, named(), nodes.where("bins is not null").select(F.col("id").alias("k1"), "bins", *MARKS), [], threshold))
    found = verified(tried[-1], nodes, texts, width, threshold)
    if not found.isEmpty():
        links = cut(links.union(found), "near-links")
        roots = connected_components(links)
    drop(found)
    return links, roots


def components(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, component_id): component_id is the smallest doc_id reachable over links."""
    return classes(docs, **how).select("doc_id", "component_id")


def keep_heads(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without all but one document of each group, by found (doc_id, body, component_id, root); columns as given."""
    first = found.where("doc_id = component_id").groupBy("root").agg(F.min("body").alias("first"))
    of_first = found.where("doc_id = component_id").join(first, "root").where("body <> first").select("doc_id", "body")
    gone = found.where("doc_id <> component_id").select("doc_id", "body").union(of_first).distinct()
    again = cut(found.groupBy("doc_id", "body").agg(F.count("*").alias("n")).where("n > 1"), "near-again")
    gone = cut(gone.select(F.col("doc_id").alias("gone_id__"), F.col("body").alias("gone_body__")), "near-gone")
    body = F.xxhash64(F.col(text_col).cast("binary"))
    kept = docs.join(gone, (docs[id_col] == gone["gone_id__"]) & (body == gone["gone_body__"]), "left_anti")
    if again.isEmpty():
        return kept
    again = again.select(F.col("doc_id").alias("gone_id__"), F.col("body").alias("gone_body__"))
    same = (kept[id_col] == again["gone_id__"]) & (body == again["gone_body__"])
    once = kept.join(again, same, "left_semi").withColumn("body__", body).dropDuplicates([id_col, "body__"]).drop("body__")
    return kept.join(again, same, "left_anti").union(once)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without all but one document of each near-duplicate group; columns as given.

    A group's document is the one with the smallest doc_id; of several texts of that doc_id, the one with the smallest
    hash. Rows without doc_id are kept; of rows that repeat doc_id and text, one is kept. Rows that repeat a doc_id with a
    text of another group are documents of their own.
    """
    found = cut(classes(docs.where(F.col(id_col).isNotNull()), id_col, text_col, **how), "near-found")
    return keep_heads(docs, found, id_col, text_col)
