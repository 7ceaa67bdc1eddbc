"""Packing documents into fixed windows with lexical retrieval.

Documents become token ids of a public tokenizer and are dealt into shards of bounded size by hash. A shard builds a BM25
inverted index over the ids of its documents. The longest unused document seeds a window; the index ranks the unused
documents by BM25 with the seed as query, and these fill the window in that order, whole where they fit; the first
that doesn't fit is cut at the window's end and its rest stays in the pool. So every window but a shard's last is full,
and the last, if short, is split at powers of two, which need no padding, as far as that saves padding.

Tokenising caches words: the tokenizer drops white space, so a text is the concatenation of its space-separated chunks,
and a chunk that of its pieces. Two generations of entries bound the caches.

Null texts are empty; an empty document is its end token alone. Documents longer than a window are cut as any other.
Repeated rows and ids are separate documents. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
SHARD_DOCS = 1024
END_ID = 2
CACHE = 300_000
K1, B = 1.2, 0.75
#: Ids in so many documents of a shard have their weights as a row over all documents, others as a list of postings.
DENSE = 32
#: Candidates that are put in order first; all others only if these don't fill the window.
FIRST = 64


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Cache(dict):
    """A memo of make(key) in two generations: a full one becomes the old one, whose keys move over when met again."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def turn(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


class ChunkTokenizer:
    """Ids of whole texts, equal to those of one encode call for each.

    Blank-separated chunks are cut into the pre-tokenizer's pieces, and new pieces go to the model alone. It holds for
    vocabularies of this kind only: lower case, no white space, pieces of letters, single digits and other runs.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.no_truncation()
        self.inner.no_padding()
        self.model = self.inner.model
        self.special = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.find = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
        ).findall
        self.pieces = _Cache(self._piece, 2 * cache)
        self.chunks = _Cache(self._chunk, cache)

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(BYTE_CHARS)
        ids = [t.id for t in self.model.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():  # most are a word, or a word and a mark
            if chunk.isalpha():
                return self.pieces[chunk.lower()]
            if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
                return self.pieces[chunk[:-1].lower()] + self.pieces[chunk[-1]]
        if "<|" in chunk and any(t in chunk for t in self.special):
            return np.array(self.inner.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
        text = unicodedata.normalize("NFC", chunk)
        # a capital sigma has one lower case here, wherever it stands
        text = "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()
        if text.isalpha():
            return self.pieces[text]
        if text[:-1].isalpha() and text[-1] in ".,;:!?":
            return self.pieces[text[:-1]] + self.pieces[text[-1]]
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        self.pieces.turn()
        self.chunks.turn()
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte: printable ones for themselves, others from 256 on in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b) if b in own else chr(next(others)) for b in range(256)}


BYTE_CHARS = _byte_chars()
_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """The worker's tokenizer, which outlives a task."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): ids with END_ID last, little-endian unsigned, 16 bits each where all fit, else 32."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [coder.encode(x.as_py() or "") + end for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_pack(x) for x in ids], pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def _pack(ids: bytes) -> bytes:
    found = np.frombuffer(ids, "<u4")
    return b"\x02" + found.astype("<u2").tobytes() if found.max() < 1 << 16 else b"\x04" + ids


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1)


class Index:
    """BM25 over one shard: postings by id, as flat arrays."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        bits = max(n - 1, 1).bit_length()
        ids = np.concatenate(docs)
        wide = np.uint32 if int(ids.max()) >> (32 - bits) == 0 else np.uint64
        # one sort by id and document serves all documents
        keys = ids.astype(wide) << wide(bits) | np.repeat(np.arange(n, dtype=wide), [len(d) for d in docs])
        keys.sort()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        tf = np.diff(first, append=len(keys)).astype(np.float64)
        keys = keys[first]
        self.doc, term = (keys & wide((1 << bits) - 1)).astype(np.int64), keys >> wide(bits)
        self.at = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        df = np.diff(self.at, append=len(term))
        self.to = self.at + df
        #: Places of each document's distinct ids among all, in ascending order.
        places = np.repeat(np.arange(len(df)), df)[np.argsort(self.doc.astype(np.uint16) if n < 1 << 16 else self.doc, kind="stable")]
        self.places = np.split(places, np.cumsum(np.bincount(self.doc, minlength=n))[:-1])
        length = np.array([len(d) for d in docs], dtype=np.float64)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / length.mean())
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])
        self.n = n
        common = np.flatnonzero(df >= DENSE)
        self.row = np.full(len(df), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n))
        held = np.repeat(self.row, df)
        self.rows[held[held >= 0], self.doc[held >= 0]] = self.weight[held >= 0]

    def scores(self, i: int) -> np.ndarray:
        """BM25 of all documents for document i's distinct ids."""
        k = self.places[i]
        row = self.row[k]
        found = self.rows[row[row >= 0]].sum(axis=0)
        k = k[row < 0]
        spans = self.to[k] - self.at[k]
        flat = np.repeat(self.at[k] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
        return found + np.bincount(self.doc[flat], weights=self.weight[flat], minlength=self.n)


def best_first(score: np.ndarray, rest: np.ndarray) -> Iterator[int]:
    """rest (ascending) by falling score, ties by place; most callers stop early, so the head is put in order first."""
    s = -score[rest]
    if len(rest) <= 2 * FIRST:
        yield from rest[np.argsort(s, kind="stable")].tolist()
        return
    limit = np.partition(s, FIRST)[FIRST]
    for some in (np.flatnonzero(s < limit), np.flatnonzero(s >= limit)):
        yield from rest[some[np.argsort(s[some], kind="stable")]].tolist()


def fill(docs: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold every id once."""
    index = Index(docs)
    length = np.array([len(d) for d in docs])
    start = np.zeros(len(docs), dtype=np.int64)
    order = np.argsort(-length, kind="stable").tolist()
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    open_docs = np.ones(len(docs), dtype=bool)
    while order:
        seed = order.pop(0)
        if not open_docs[seed]:
            continue
        while length[seed] - start[seed] >= window:
            pieces.append((seed, int(start[seed]), window, sequence, 0))
            start[seed] += window
            sequence += 1
        offset = 0
        if start[seed] < length[seed]:
            offset = int(length[seed] - start[seed])
            pieces.append((seed, int(start[seed]), offset, sequence, 0))
            start[seed] = length[seed]
        open_docs[seed] = False
        if not offset:
            continue
        rest = np.flatnonzero(open_docs)
        if len(rest):
            for i in best_first(index.scores(seed), rest):
                n = int(min(length[i] - start[i], window - offset))
                pieces.append((i, int(start[i]), n, sequence, offset))
                start[i] += n
                offset += n
                if start[i] == length[i]:
                    open_docs[i] = False
                if offset == window:
                    break
        sequence += 1
    return split_last(pieces, window)


def split_last(pieces: list[tuple[int, int, int, int, int]], window: int) -> list[tuple[int, int, int, int, int]]:
    """The last sequence, if short, as sequences whose lengths are powers of two; they need no padding."""
    if not pieces:
        return pieces
    last = pieces[-1][3]
    tail = [p for p in pieces if p[3] == last]
    total = sum(p[2] for p in tail)
    if total == window:
        return pieces
    out = [p for p in pieces if p[3] != last]
    cuts = [1 << b for b in range(window.bit_length() - 1, -1, -1) if total >> b & 1]
    sequence, room, offset = last, cuts.pop(0), 0
    for doc, at, n, _, _ in tail:
        while n:
            if not room:
                sequence, room, offset = sequence + 1, cuts.pop(0), 0
            take = min(n, room)
            out.append((doc, at, take, sequence, offset))
            at, n, room, offset = at + take, n - take, room - take, offset + take
    return out


PIECE = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, path: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (array), ids_crc32, doc_tokens, sequence_id, offset."""
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    # rows that repeat an id are spread by their content's checksum
    dealt = tokenised(docs, id_col, text_col, path).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.crc32("ids")), F.lit(shards)))
    schema = ", ".join(f"{k} {'binary' if k == 'ids' else 'long'}" for k in PIECE)

    def run(table: pa.Table) -> pa.Table:
        raw, names = table.column("ids").to_pylist(), table.column("doc_id").to_pylist()
        order = sorted(range(len(raw)), key=lambda i: (names[i] is None, names[i] or 0, raw[i]))
        ids = [_unpack(raw[i]) for i in order]
        base = table.column("shard")[0].as_py() << 32
        pieces = fill(ids, window)
        parts = [ids[i][at : at + n].astype("<u4").tobytes() for i, at, n, _, _ in pieces]
        columns = [
            [names[order[p[0]]] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], parts, [zlib.crc32(x) for x in parts],
            [len(ids[p[0]]) for p in pieces], [base + p[3] for p in pieces], [p[4] for p in pieces],
        ]
        kinds = [pa.binary() if k == "ids" else pa.int64() for k in PIECE]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=PIECE)

    return dealt.groupBy("shard").applyInArrow(run, schema)


def op10_lexical_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed(docs).drop("ids")
