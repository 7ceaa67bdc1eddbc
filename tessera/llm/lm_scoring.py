"""Language-model scores from a trigram trie in Elias-Fano form.

Every word of the training documents is a word of the model, and every n-gram counts, seen once or often. Absolute
discounting: the share of a word after a context is (count - discount) / count of the context, and what a context's words
leave is passed to the next lower order, down to add-one over single words with exact counts. The HEAD most frequent words
are told by rank; all others by a 31-bit hash in n-grams, so of V such words about V / 2^32 share theirs with another's.

Texts are tokenised once to count words and once into chunks, which are written to the shared folder: token codes and the
distinct words beyond the head. A chunk's distinct n-grams and rare words, with their training counts, go to shards: by
a hash of their first two words, or of the first alone if it is rare, which meets its own n-grams there. A shard sums the
counts, builds one trie, looks everything up and answers each chunk; a chunk meets its answers and scores its texts. So
no task holds the model or the vocabulary: a shard's size, a chunk's and the head's are constants, and only the head's
words and counts are broadcast (HEAD words of HEAD_BYTES at most). A trie's levels are flat arrays in one buffer, looked
up in place. One text is in one chunk, however long it is.

Nulls are empty texts: one end token. Rows without doc_id are training rows. Repeated rows are scored and counted each
for itself. Extra columns are ignored. An empty table gives an empty result; without training rows all counts are 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.elias_fano import WORD, Trie
from tessera.storage import cut, drop, release

HEAD = 65_534  # frequent words, whose ids are ranks
HEAD_BYTES = 64
END = 0
TAIL = HEAD + 2  # ids of all other words, from here to 2^31
TAIL_IDS = (1 << 31) - TAIL
DISCOUNT = 0.75
CHUNK_BYTES = 3 << 20
SHARD_TOKENS = 1 << 20


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tail_id(word: bytes) -> int:
    """The id of a word beyond the head."""
    h = xxhash.xxh64_intdigest(word, 42)
    return TAIL + (h - (h >> 63 << 64)) % TAIL_IDS


def word_counts(training: DataFrame) -> DataFrame:
    """training (text) to (word, c); each task sums what fits before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update((text.as_py() or b"").lower().split())
                if len(counts) > 200_000:
                    yield _counts_batch(counts)
                    counts = Counter()
        if counts:
            yield _counts_batch(counts)

    return training.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _counts_batch(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"]
    )


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their types, byte planes side by side, compressed."""
    parts = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
        parts += [a.dtype.str[1:].encode(), len(a).to_bytes(8, "little"), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    at, out = 1, []
    for _ in range(raw[0]):
        kind, n = np.dtype("<" + raw[at : at + 2].decode()), int.from_bytes(raw[at + 2 : at + 10], "little")
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 10).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += 10 + n * kind.itemsize
    return out


def steps(ordered: np.ndarray) -> np.ndarray:
    return np.diff(ordered, prepend=0)


FORM = "chunk long, doc_ids array<long>, held array<boolean>, tokens binary, tail array<binary>"


def formed(rows: DataFrame, head) -> DataFrame:
    """rows (doc_id, held_out, text) to chunks of whole texts.

    tokens: words of each text, a code for each token (0 the end, ranks from 1, from TAIL places in tail), tail's ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ranks, chunk = head.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.cumsum(sizes) // CHUNK_BYTES
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    yield form(chunk, batch.slice(a, b - a), ranks)
                    chunk += 1

    def form(chunk: int, part: pa.RecordBatch, ranks: dict[bytes, int]) -> pa.RecordBatch:
        tail: dict[bytes, int] = {}
        lengths, codes = np.zeros(part.num_rows, "<i8"), []
        for i, text in enumerate(part.column(2)):
            words = (text.as_py() or b"").lower().split()
            lengths[i] = len(words)
            found = [ranks.get(w) or tail.setdefault(w, TAIL + len(tail)) for w in words]
            codes.append(np.array([*found, END], "<i4"))
        tokens = pack(lengths, np.concatenate(codes), np.fromiter(map(tail_id, tail), "<i4", len(tail)))
        values = [chunk, part.column(0).to_pylist(), part.column(1).to_pylist(), tokens, list(tail)]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.list_(pa.binary())]
        names = ["chunk", "doc_ids", "held", "tokens", "tail"]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    return rows.mapInArrow(run, FORM)


class Grams:
    """Distinct pairs, triples and rare words of a chunk, by shard, and which of them stands at each place."""

    def __init__(self, tokens: bytes, shards: int):
        self.lengths, self.codes, tail = unpack(tokens)
        tail_ids = tail.astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths + 1)
        ids = self.codes.astype(np.int64)
        rare = ids >= TAIL
        ids[rare] = tail_ids[ids[rare] - TAIL]
        self.places = np.flatnonzero(self.doc[1:] == self.doc[:-1])
        pairs, at = np.unique(ids[self.places] << 32 | ids[self.places + 1], return_inverse=True)
        where = shard_of(pairs, shards)
        order = np.argsort(where, kind="stable")
        self.pairs = pairs[order]
        self.edges = np.searchsorted(where[order], np.arange(shards + 1))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.pair_at = rank[at]
        more = np.flatnonzero(self.codes[self.places + 1] != END)
        self.places3 = self.places[more]
        self.triples, self.triple_at = np.unique(self.pair_at[more] << 32 | ids[self.places3 + 2], return_inverse=True)
        self.edges3 = np.searchsorted(self.triples >> 32, self.edges)
        where = shard_of(tail_ids << 32, shards)
        self.tail_order = np.argsort(where, kind="stable")
        self.tail_edges = np.searchsorted(where[self.tail_order], np.arange(shards + 1))
        self.tail_ids = tail_ids


def shard_of(uv: np.ndarray, shards: int) -> np.ndarray:
    """Even shards, by Fibonacci hashing of the first two words, or of the first if it is rare."""
    h = np.where(uv >> 32 >= TAIL, uv & ~WORD, uv).astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(33)).astype(np.int64) % shards


def counted(forms: DataFrame, shards: int) -> DataFrame:
    """forms to (shard, chunk, grams): each shard's part of a chunk's pairs, triples and rare words, with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, held, tokens, tail in zip(*(batch.column(i) for i in range(4)), strict=True):
                g = Grams(tokens.as_py(), shards)
                learns = ~np.array(held.as_py(), dtype=bool)[g.doc]
                c2 = np.bincount(g.pair_at, weights=learns[g.places], minlength=len(g.pairs)).astype("<u4")
                c3 = np.bincount(g.triple_at, weights=learns[g.places3], minlength=len(g.triples)).astype("<u4")
                rare = g.codes >= TAIL
                c1 = np.bincount(g.codes[rare] - TAIL, weights=learns[rare], minlength=len(g.tail_ids)).astype("<u4")[g.tail_order]
                ids, words = g.tail_ids[g.tail_order].astype("<i4"), tail.values.take(pa.array(g.tail_order))
                sizes = pc.binary_length(words).to_numpy().astype("<u4")
                ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                letters = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
                found, blobs = [], []
                for s in np.flatnonzero(np.diff(g.edges) + np.diff(g.tail_edges)).tolist():
                    a, b, a3, b3 = g.edges[s], g.edges[s + 1], g.edges3[s], g.edges3[s + 1]
                    some, a1, b1 = g.triples[a3:b3], g.tail_edges[s], g.tail_edges[s + 1]
                    found.append(s)
                    blobs.append(pack(
                        steps(g.pairs[a:b]), c2[a:b], steps((some >> 32) - a).astype("<u4"), (some & WORD).astype("<u4"), c3[a3:b3],
                        ids[a1:b1], c1[a1:b1], sizes[a1:b1], letters[ends[a1] : ends[b1]],
                    ))
                names, columns = ["shard", "chunk", "grams"], [found, [chunk.as_py()] * len(found), blobs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names
                )

    return forms.select("chunk", "held", "tokens", "tail").mapInArrow(run, "shard long, chunk long, grams binary")


ANSWER = "chunk long, shard long, answers binary, u array<long>, followers array<long>"


def answered(grams: DataFrame) -> DataFrame:
    """counted() to the answers for each chunk: pairs' discounted counts, the mass they leave, triples' shares, and rare
    words' counts, those as a context, and the numbers of words that follow.

    A row without chunk has the shard's frequent contexts of one word, with the number of words that follow each.
    """

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in table.column("grams")]
        sizes, sizes3, sizes1 = ([len(p[i]) for p in parts] for i in (0, 2, 5))
        rare = rare_counts(parts)
        pairs, at = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
        c2 = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(pairs)).astype(np.int64)
        starts = np.cumsum([0, *sizes])
        first = np.concatenate([np.cumsum(p[2], dtype=np.int64) + a for p, a in zip(parts, starts, strict=False)])
        words = np.concatenate([p[3] for p in parts]).astype(np.int64)
        triples, at3 = np.unique(at[first] << 32 | words, return_inverse=True)
        c3 = np.bincount(at3, weights=np.concatenate([p[4] for p in parts]), minlength=len(triples)).astype(np.int64)
        del parts, first, words
        seen, seen3 = c2 > 0, c3 > 0
        place = np.cumsum(seen) - 1
        learnt = triples[seen3]
        trie = Trie.build(pairs[seen], c2[seen], place[learnt >> 32] << 32 | learnt & WORD, c3[seen3], DISCOUNT)
        trie = Trie.frombuffer(np.frombuffer(trie.tobytes(), np.uint8))
        node, count, rest = trie.pair(pairs >> 32, pairs & WORD)
        share = trie.triple(node[triples >> 32], triples & WORD)
        coded = [Coded(x) for x in (count, rest, share)]
        u, followers = np.unique(pairs[seen] >> 32, return_counts=True)
        of = np.searchsorted(u, rare[0])
        after = np.where(np.append(u, -1)[of] == rare[0], np.append(followers, 0)[of], 0)
        ends, ends3, ends1 = (np.cumsum(x) for x in (sizes, sizes3, sizes1))
        answers = []
        for i, (n, n3, n1) in enumerate(zip(sizes, sizes3, sizes1, strict=True)):
            mine, mine3, mine1 = at[ends[i] - n : ends[i]], at3[ends3[i] - n3 : ends3[i]], slice(ends1[i] - n1, ends1[i])
            c, total = rare[1][mine1], rare[2][mine1]
            learnt = [a for x, some in zip(coded, (mine, mine, mine3), strict=True) for a in x.part(some)]
            answers.append(pack(*learnt, c, total - c, total - after[mine1]))
        u, followers = u[u < TAIL], followers[u < TAIL]
        k, shard = len(answers), table.column("shard")[0].as_py()
        columns = [
            [*table.column("chunk").to_pylist(), None], [shard] * (k + 1), [*answers, None], [None] * k + [u], [None] * k + [followers]
        ]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["chunk", "shard", "answers", "u", "followers"])

    return grams.groupBy("shard").applyInArrow(run, ANSWER)


class Coded:
    """Numbers of few distinct values, whose parts travel as codes and the values that they use."""

    def __init__(self, values: np.ndarray):
        self.book, self.code = np.unique(values.astype("<f4"), return_inverse=True)

    def part(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = self.code[places]
        used = np.bincount(code, minlength=len(self.book)) > 0
        return self.book[used], (np.cumsum(used) - 1)[code].astype("<u2")


def _told(*a: np.ndarray) -> list[np.ndarray]:
    """An answer's arrays as they were: three coded ones, then counts, totals and followers of rare words."""
    c, more, fewer = a[6:]
    return [a[0][a[1]], a[2][a[3]], a[4][a[5]], c, c + more, c + more - fewer]


def rare_counts(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the parts' rare words in turn: its id, its count over all parts, and its id's."""
    ids, counts, sizes, letters = (np.concatenate([p[i] for p in parts]) for i in range(5, 9))
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    at = words.dictionary_encode().indices.to_numpy()
    _, at_id = np.unique(ids, return_inverse=True)
    c, total = (np.bincount(x, weights=counts).astype(np.int64)[x] if len(x) else x.astype(np.int64) for x in (at, at_id))
    return ids.astype(np.int64), c, total


SCORED = [
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()),
]


def evaluated(parts: DataFrame, known, shards: int, n: int, v: int, n_docs: int) -> DataFrame:
    """A chunk's form and answers to its documents' scores; known: counts of frequent words, and words that follow them."""

    def run(table: pa.Table) -> pa.Table:
        form = table.filter(pc.is_valid(table.column("tokens")))
        g = Grams(form.column("tokens")[0].as_py(), shards)
        got = table.filter(pc.is_valid(table.column("answers"))).sort_by("shard").column("answers")
        answers = [_told(*unpack(x.as_py())) for x in got]
        count, rest, share, *rare = (np.concatenate([a[i] for a in answers] or [np.zeros(0)]).astype(np.float64) for i in range(6))
        c, total, followers = (np.concatenate([known.value[i], np.zeros(len(g.tail_ids))]) for i in (0, 0, 1))
        for x, found in zip((c, total, followers), rare, strict=True):
            x[TAIL + g.tail_order] = found
        log_single = np.log10(c + 1) - np.log10(n + v + 1)
        p = 10.0 ** log_single[g.codes]
        u = g.codes[g.places]
        after, of = g.places + 1, np.maximum(total[u], 1)
        seen = total[u] > 0
        p[after] = np.where(seen, count[g.pair_at] / of, 0) + np.where(seen, DISCOUNT * followers[u] / of, 1) * p[after]
        p[g.places3 + 2] = share[g.triple_at] + rest[g.triples[g.triple_at] >> 32] * p[g.places3 + 2]
        size = len(g.lengths)
        columns = [
            form.column("doc_ids")[0].values,
            form.column("held")[0].values,
            g.lengths + 1,
            np.bincount(g.doc, weights=c[g.codes] > 0, minlength=size).astype(np.int64),
            np.bincount(g.doc, weights=log_single[g.codes], minlength=size),
            np.bincount(g.doc, weights=np.log10(p), minlength=size),
        ]
        return pa.table([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], schema=pa.schema(SCORED))

    types = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return parts.groupBy("chunk").applyInArrow(run, types)


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text")
    )
    training = rows.where("not held_out").select("text")
    counts = cut(word_counts(training), "lm-words")
    facts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_docs = training.count()
    n, v = facts["n"] + n_docs, facts["v"] + (n_docs > 0)
    head = counts.where(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    words = head.column("word").to_pylist()
    c = np.zeros(TAIL)
    c[END], c[1 : len(words) + 1] = n_docs, np.array(head.column("c"))
    ranks = spark.sparkContext.broadcast({w: i + 1 for i, w in enumerate(words)})
    shards = max(1, -(-n // SHARD_TOKENS))
    forms = cut(formed(rows, ranks), "lm-chunks")
    answers = cut(answered(counted(forms, shards)), "lm-answers")
    release(spark)
    common = answers.where("chunk is null").select(F.explode(F.arrays_zip("u", "followers")).alias("x"))
    common = common.groupBy(F.col("x.u").alias("id")).agg(F.sum("x.followers").alias("followers")).toArrow()
    head_followers = np.zeros(TAIL)
    head_followers[np.array(common.column("id"), dtype=np.int64)] = np.array(common.column("followers"))
    known = spark.sparkContext.broadcast((c, head_followers))
    parts = forms.select("chunk", "doc_ids", "held", "tokens")
    parts = parts.unionByName(answers.where("chunk is not null").select("chunk", "shard", "answers"), allowMissingColumns=True)
    out = cut(evaluated(parts, known, shards, n, v, n_docs), "lm-scored")
    drop(counts, forms, answers)
    release(spark)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_ngram_trie_scores(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
