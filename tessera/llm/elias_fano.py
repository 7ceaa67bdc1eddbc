"""Elias-Fano sequences and an n-gram trie on them, in flat arrays that can be mapped from a file.

A monotone sequence is split into low bits, kept as they are in whole bytes, and high bits, kept in unary with a select
sample for every 16th element. A block of 16 is decoded by reading its samples' span of the bitmap, so lookups cost in
proportion to the blocks they touch, whatever the sequence's length.
"""

from __future__ import annotations

import numpy as np

BLOCK = 16
WORD = (1 << 32) - 1


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bytes: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray, heads: np.ndarray):
        self.n, self.low_bytes, self.low, self.high, self.samples, self.heads = n, low_bytes, low, high, samples, heads

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        per = max(universe // max(n, 1), 1)
        low_bytes = -(-max(per.bit_length() - 1, 0) // 8)
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :low_bytes].copy().ravel()
        at = (values >> (8 * low_bytes)) + np.arange(n)
        bits = np.zeros((int(at[-1]) + 8) // 8 * 8 if n else 0, dtype=np.uint8)
        bits[at] = 1
        samples = np.concatenate([at[::BLOCK], [int(at[-1]) + 1 if n else 0]]).astype("<i8")
        return cls(n, low_bytes, low, np.packbits(bits, bitorder="little"), samples, values[::BLOCK].astype("<i8"))

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bytes], "<i8"), self.low, self.high, self.samples, self.heads]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> EliasFano:
        head, low, high, samples, heads = arrays
        return cls(int(head[0]), int(head[1]), low, high, samples.view("<i8"), heads.view("<i8"))

    def blocks(self, ids: np.ndarray) -> np.ndarray:
        """Decoded blocks, one a row; past the sequence's end the largest integer."""
        starts, ends = self.samples[ids], self.samples[ids + 1]
        spans = ends - starts
        first = np.cumsum(spans) - spans
        flat = np.repeat(starts - first, spans) + np.arange(int(spans.sum()))
        ones = np.flatnonzero((self.high[flat >> 3] >> (flat & 7).astype(np.uint8)) & 1)
        at = flat[ones]
        row = np.searchsorted(first, ones, "right") - 1
        counts = np.minimum(self.n - ids * BLOCK, BLOCK)
        rank = np.arange(len(ones)) - np.repeat(np.cumsum(counts) - counts, counts)
        index = ids[row] * BLOCK + rank
        value = (at - index) << (8 * self.low_bytes)
        for b in range(self.low_bytes):
            value |= self.low[index * self.low_bytes + b].astype(np.int64) << (8 * b)
        out = np.full((len(ids), BLOCK), np.iinfo(np.int64).max)
        out[row, rank] = value
        return out

    def get(self, index: np.ndarray) -> np.ndarray:
        """Elements at positions."""
        ids, inverse = np.unique(index // BLOCK, return_inverse=True)
        return self.blocks(ids)[inverse, index % BLOCK] if len(index) else np.zeros(0, np.int64)

    def successor(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and value of the first element that isn't below each target; position n where none is."""
        position, value = np.full(len(target), self.n), np.full(len(target), np.iinfo(np.int64).max)
        if not self.n or not len(target):
            return position, value
        block = np.maximum(np.searchsorted(self.heads, target, "left") - 1, 0)
        ids, inverse = np.unique(block, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        rows = self.blocks(ids)
        for at in range(0, len(order), 1 << 16):
            some = order[at : at + (1 << 16)]
            k = (rows[inverse[some]] < target[some, None]).sum(axis=1)
            inside = k < BLOCK
            position[some] = np.minimum(block[some] * BLOCK + k, self.n)
            value[some[inside]] = rows[inverse[some[inside]], k[inside]]
        past = np.flatnonzero((value == np.iinfo(np.int64).max) & (position < self.n))
        if len(past):
            value[past] = self.get(position[past])
        return position, value


class Quantiser:
    """Numbers in (0, 1] as one byte: 128 quantiles of their logarithms and as many even steps, so no gap is wide."""

    def __init__(self, codebook: np.ndarray):
        self.codebook = codebook

    @classmethod
    def fit(cls, values: np.ndarray) -> Quantiser:
        logs = np.log10(np.maximum(values, 1e-12))
        if not len(logs):
            return cls(np.zeros(1, "<f8"))
        book = np.concatenate([np.quantile(logs, np.linspace(0, 1, 128)), np.linspace(logs.min(), logs.max(), 128)])
        return cls(np.unique(book).astype("<f8"))

    def encode(self, values: np.ndarray) -> np.ndarray:
        logs = np.log10(np.maximum(values, 1e-12))
        k = np.clip(np.searchsorted(self.codebook, logs), 1, max(len(self.codebook) - 1, 1))
        left = np.abs(logs - self.codebook[k - 1]) <= np.abs(self.codebook[np.minimum(k, len(self.codebook) - 1)] - logs)
        return np.where(left, k - 1, np.minimum(k, len(self.codebook) - 1)).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return 10.0 ** self.codebook[codes]


class Level:
    """Successors of each context of one order, context-relative: a context's words follow the last value before it.

    pointers: where each context's words start; words: base + word, base the last value of the context before.
    """

    def __init__(self, pointers: EliasFano, words: EliasFano, prob: np.ndarray, book: Quantiser, rest: np.ndarray, rest_book: Quantiser):
        self.pointers, self.words, self.prob, self.book, self.rest, self.rest_book = pointers, words, prob, book, rest, rest_book

    @classmethod
    def build(cls, parent: np.ndarray, word: np.ndarray, n_parents: int, prob: np.ndarray, rest: np.ndarray) -> Level:
        """parent, word: ordered; prob: discounted share of each; rest: mass that each parent leaves to lower orders."""
        pointers = np.searchsorted(parent, np.arange(n_parents + 1))
        last = np.flatnonzero(np.diff(parent, append=-1)) if len(parent) else np.zeros(0, np.int64)
        span = np.zeros(n_parents, dtype=np.int64)
        span[parent[last]] = word[last]
        base = np.cumsum(span) - span
        book, rest_book = Quantiser.fit(prob), Quantiser.fit(rest)
        return cls(EliasFano.encode(pointers), EliasFano.encode(base[parent] + word), book.encode(prob), book, rest_book.encode(rest), rest_book)

    def find(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Position of word among parent's successors; -1 where it isn't one."""
        out = np.full(len(parent), -1, dtype=np.int64)
        start, end = self.pointers.get(parent), self.pointers.get(parent + 1)
        base = np.zeros(len(parent), dtype=np.int64)
        base[start > 0] = self.words.get(start[start > 0] - 1)
        at, value = self.words.successor(base + word)
        early = at < start  # equal values that end the context before
        at[early] = start[early]
        inside = early & (start < end)
        value[inside] = self.words.get(start[inside])
        hit = (at < end) & (value == base + word)
        out[hit] = at[hit]
        return out

    def arrays(self) -> list[np.ndarray]:
        return [*self.pointers.arrays(), *self.words.arrays(), self.prob, self.book.codebook, self.rest, self.rest_book.codebook]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> Level:
        prob, book, rest, rest_book = arrays[10:14]
        return cls(
            EliasFano.of([arrays[0].view("<i8"), *arrays[1:5]]), EliasFano.of([arrays[5].view("<i8"), *arrays[6:10]]),
            prob, Quantiser(book.view("<f8")), rest, Quantiser(rest_book.view("<f8")),
        )


class Trie:
    """Contexts by first word, then their successors, then theirs."""

    def __init__(self, roots: EliasFano, pairs: Level, triples: Level):
        self.roots, self.pairs, self.triples = roots, pairs, triples

    @classmethod
    def build(cls, uv: np.ndarray, c_uv: np.ndarray, uvw: np.ndarray, c_uvw: np.ndarray, discount: float) -> Trie:
        """uv: ordered keys of two words of 32 bits; uvw: ordered, a pair's place in uv and a third word; with counts.

        A context's first word may stand in several tries, so pairs hold their discounted counts, to be divided by the
        count of the first word; what it leaves to the lowest order isn't kept here.
        """
        u = uv >> 32
        roots = np.unique(u)
        pairs = Level.build(np.searchsorted(roots, u), uv & WORD, len(roots), c_uv - discount, np.ones(len(roots)))
        parent = uvw >> 32
        share = (c_uvw - discount) / c_uv[parent]
        rest = 1 - np.bincount(parent, weights=share, minlength=len(uv))
        return cls(EliasFano.encode(roots), pairs, Level.build(parent, uvw & WORD, len(uv), share, rest))

    def pair(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position of (u, v), -1 where it isn't held, its discounted count, and the mass it leaves to lower orders."""
        node, count, rest = np.full(len(u), -1), np.zeros(len(u)), np.ones(len(u))
        at, value = self.roots.successor(u)
        known = np.flatnonzero(value == u)
        node[known] = self.pairs.find(at[known], v[known])
        hit = np.flatnonzero(node >= 0)
        count[hit] = self.pairs.book.decode(self.pairs.prob[node[hit]])
        rest[hit] = self.triples.rest_book.decode(self.triples.rest[node[hit]])
        return node, count, rest

    def triple(self, node: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Discounted share of w after the pair at node."""
        share = np.zeros(len(node))
        known = np.flatnonzero(node >= 0)
        at = self.triples.find(node[known], w[known])
        hit = at >= 0
        share[known[hit]] = self.triples.book.decode(self.triples.prob[at[hit]])
        return share

    def tobytes(self) -> bytes:
        """A header of array lengths, then the arrays, each on a multiple of eight bytes."""
        arrays = [a.view(np.uint8) for a in (*self.roots.arrays(), *self.pairs.arrays(), *self.triples.arrays())]
        head = np.array([len(arrays), *map(len, arrays)], "<i8").tobytes()
        return head + b"".join(a.tobytes() + bytes(-len(a) % 8) for a in arrays)

    @classmethod
    def frombuffer(cls, raw: np.ndarray) -> Trie:
        n = int(raw[:8].view("<i8")[0])
        lengths = raw[8 : 8 * (n + 1)].view("<i8")
        at, arrays = 8 * (n + 1), []
        for length in lengths.tolist():
            arrays.append(raw[at : at + length])
            at += length + -length % 8
        roots = EliasFano.of([arrays[0].view("<i8"), *arrays[1:5]])
        return cls(roots, Level.of(arrays[5:19]), Level.of(arrays[19:33]))
