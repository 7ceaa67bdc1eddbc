"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits. The popcounts of the segments (0, 1 or 2) embed it in a
32-dimensional lattice; one differing bit moves one coordinate by one, so the Manhattan distance of two embeddings is a
lower bound of their Hamming distance. Counts are held in unary ("thermometer") form, two bits each, which makes the
Manhattan distance of two embeddings the popcount of an XOR.

Grid range-join: the 32 coordinates form eight groups of four. Within Manhattan distance 4 at most four groups differ,
so two linked fingerprints share a cell in at least one of the 70 grids that keep four whole groups. Cells are small
(about 22 bits of selectivity); members of a cell are compared by the Manhattan bound first, then exactly.

Cells are never expanded into all pairs: above PAIR_LIMIT members a breadth-first search compares each pivot with the
not yet reached members only and returns a spanning forest. Cells above hot_cell members are left to an exact linear
way: each member names the 2081 values within two bits of it, and two fingerprints differ in at most four bits exactly
if they name a common value.

Nulls and texts without words have fingerprint zero. Repeated rows and texts share a fingerprint and are collapsed
before the join. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.graph_components import connected_components
from tessera.llm.near_text import keep_heads
from tessera.storage import cut, drop, release

MAX_BITS = 4
PAIR_LIMIT = 64
HOT_CELL = 20_000
BLOCK = 1 << 15
LOW_BITS = 0x5555555555555555
#: For each grid, the four of eight bytes of the embedding that a cell fixes.
GRIDS = [sum(0xFF << (8 * g) for g in keep) for keep in combinations(range(8), 4)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(text: bytes | None, width: int = 4) -> int:
    """Unsigned fingerprint of a whole UTF-8 text; blocks bound the memory of very long ones."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    starts = list(accumulate(map(len, words), lambda p, n: p + n + 1, initial=0))
    total = len(words) - width + 1
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, BLOCK):
        upto = min(total, at + BLOCK)
        pairs = zip(starts[at:upto], starts[at + width : upto + width], strict=True)
        hashes = np.array([digest(joined[a : b - 1], 42) for a, b in pairs], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """simhash() of a text whose shingles, repeats included, have these unsigned hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, body, fp): the text's hash, and its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(x.as_py(), width) for x in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "body", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("body"), "text").mapInArrow(run, "doc_id long, body long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Unary popcounts of the 32 two-bit segments."""
    low = np.uint64(LOW_BITS)
    shifted = fp >> np.uint64(1)
    return ((((fp | shifted) & low) << np.uint64(1)) | (fp & shifted & low)).astype(np.uint64)


def near(fp_a: np.ndarray, fp_b: np.ndarray, emb_a: np.ndarray, emb_b: np.ndarray, bits: int) -> np.ndarray:
    """Manhattan lower bound first, the exact Hamming distance for what passes."""
    ok = np.bitwise_count(emb_a ^ emb_b) <= bits
    ok[ok] = np.bitwise_count((fp_a ^ fp_b)[ok]) <= bits
    return ok


def spanning_edges(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of one cell's links; at most one edge a member."""
    emb, rest = embed(fp), np.arange(len(fp))
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        pivot = queue.pop()
        hit = near(fp[rest], fp[pivot], emb[rest], emb[pivot], bits)
        found = rest[hit]
        if len(found):
            left.append(found)
            right.append(np.full(len(found), pivot))
            rest = rest[~hit]
            queue.extend(found.tolist())
    if not left:
        return fp[:0], fp[:0]
    return fp[np.concatenate(left)], fp[np.concatenate(right)]


def cell_edges(cell: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all cells in arrays that are ordered by cell."""
    change = np.flatnonzero(np.diff(cell)) + 1
    starts = np.concatenate(([0], change)).astype(np.int64)
    sizes = np.diff(np.concatenate((starts, [len(cell)])))
    left, right = [], []
    small = np.repeat((sizes > 1) & (sizes <= PAIR_LIMIT), sizes)
    if small.any():
        c, f = cell[small], fp[small]
        e = embed(f)
        for d in range(1, int(sizes[(sizes > 1) & (sizes <= PAIR_LIMIT)].max())):
            same = np.flatnonzero(c[d:] == c[:-d])
            if not len(same):
                break
            ok = same[near(f[same], f[same + d], e[same], e[same + d], bits)]
            left.append(f[ok])
            right.append(f[ok + d])
    for k in np.flatnonzero(sizes > PAIR_LIMIT):
        a, b = spanning_edges(np.unique(fp[starts[k] : starts[k] + sizes[k]]), bits)
        left.append(a)
        right.append(b)
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def _edge_batch(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
    keep = (a != b) | hot
    a, b = a[keep].view(np.int64), b[keep].view(np.int64)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(np.full(len(pairs), hot))], names=["a", "b", "hot"]
    )


def link_edges(fps: DataFrame, bits: int = MAX_BITS, hot_cell: int = HOT_CELL) -> DataFrame:
    """fps (fp: distinct longs) to (a, b): edges that connect exactly the fingerprints reachable over links."""
    spark = fps.sparkSession
    low = F.lit(LOW_BITS)
    fp, half = F.col("fp"), F.shiftrightunsigned("fp", 1)
    emb = F.shiftleft(fp.bitwiseOR(half).bitwiseAND(low), 1).bitwiseOR(fp.bitwiseAND(half).bitwiseAND(low))
    grids = F.array(*[F.lit(signed(m)) for m in GRIDS])
    cells = (
        fps.select("fp", emb.alias("e"), F.explode(grids).alias("m"))
        .select(F.col("e").bitwiseAND(F.col("m")).alias("cell"), "fp")
        .repartition("cell")
        .sortWithinPartitions("cell")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_c, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hot = None  # the cell whose members go to the linear way
        for batch in batches:
            c = np.concatenate([held_c, batch.column(0).to_numpy()])
            f = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
            if not len(c):
                continue
            if hot is not None:
                n = int(np.searchsorted(c, hot, "right"))
                yield _edge_batch(f[:n], f[:n], True)
                c, f = c[n:], f[n:]
                if not len(c):
                    held_c, held_f = c, f
                    continue
                hot = None
            tail = int(np.searchsorted(c, c[-1]))
            yield _edge_batch(*cell_edges(c[:tail], f[:tail], bits), False)
            held_c, held_f = c[tail:], f[tail:]
            if len(held_c) > hot_cell:
                hot = held_c[0]
                yield _edge_batch(held_f, held_f, True)
                held_c, held_f = held_c[:0], held_f[:0]
        if len(held_c):
            yield _edge_batch(*cell_edges(held_c, held_f, bits), False)

    found = cut(cells.mapInArrow(run, "a long, b long, hot boolean").distinct(), "simhash-edges")
    release(spark)
    edges = found.where("not hot").select("a", "b")
    hot = found.where("hot").select(F.col("a").alias("fp")).distinct()
    if hot.isEmpty():
        return edges
    return edges.union(midpoint_edges(hot))


def midpoint_edges(fps: DataFrame) -> DataFrame:
    """Exact links at four bits or fewer in linear work: members that name a common value are tied to its smallest."""
    one = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    bits = F.concat(F.array(F.lit(0).cast("long")), one)
    masks = F.array_distinct(F.flatten(F.transform(bits, lambda a: F.transform(bits, lambda b: a.bitwiseXOR(b)))))
    named = fps.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
    least = named.groupBy("v").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("v", "b")
    return named.join(least, "v").select(F.col("fp").alias("a"), "b").where("a <> b").distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = MAX_BITS, hot_cell: int = HOT_CELL) -> DataFrame:
    """(doc_id, body, fp, component_id, root, n_copies): component_id is the smallest doc_id reachable over links."""
    spark = docs.sparkSession
    marked = cut(fingerprints(docs, id_col, text_col, width), "simhash-fp")
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")), "simhash-nodes")
    found = connected_components(link_edges(nodes.select("fp"), bits, hot_cell))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select(
        nodes["fp"], "rep", "n_copies", F.coalesce("root", nodes["fp"]).alias("root")
    )
    rooted = cut(rooted, "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = cut(rooted.join(least, "root").select("fp", "n_copies", "component_id", "root"), "simhash-classes")
    drop(nodes, rooted)
    release(spark)
    return marked.join(classes, "fp").select("doc_id", "body", "fp", "component_id", "root", "n_copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without all but one document of each near-duplicate group, chosen as near_text.keep_one does; columns as given."""
    found = cut(components(docs.where(F.col(id_col).isNotNull()), id_col, text_col, **how), "simhash-found")
    return keep_heads(docs, found, id_col, text_col)


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies"
    )
