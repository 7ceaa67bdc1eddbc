"""Each operator against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and odd columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import elias_fano, host_quality, licenses, line_dedup, lm_scoring, mixing, packing, sharding, simhash, topk_nra, url_rules

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def texts(seed=0, n=60):
    """Documents with copies, near copies, repeated lines, nulls, blanks and one very long text."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    out = [(i, "\n".join(line(rng.randint(3, 14)) for _ in range(rng.randint(1, 8))), f"src{i % 3}") for i in range(n)]
    long = line(30_000)
    near = long.split(" ")
    near[77] = "changed"
    base = out[3][1].split("\n")
    out += [(n, out[3][1], "src0"), (n + 1, None, None), (n + 2, "", "src1"), (n + 3, " \n\t", "src1"), (n + 4, long, "src2")]
    out += [(n + 5, " ".join(near), "src2"), (n + 6, out[5][1].upper(), None), (n + 7, "\n".join([base[0] + " more", *base[1:]]), "src0")]
    return out + [out[7]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, i, 1) for i, r in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, fp int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def words_of(text):
    return SPACE.findall((text or "").encode())


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def slow_simhash(text, width):
    ws = words_of((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("hot", [simhash.HOT_CELL, 1])
def test_simhash(docs, none, hot):
    out = {r["doc_id"]: r for r in simhash.components(docs, hot_cell=hot).collect()}
    want = {i: slow_simhash(t, 4) for i, t, _ in texts()}
    assert {i: r["fp"] % (1 << 64) for i, r in out.items()} == want
    links = [(a, b) for a in want for b in want if a < b and (want[a] ^ want[b]).bit_count() <= 4]
    assert {i: r["component_id"] for i, r in out.items()} == components(want, links)
    assert simhash.components(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(components(want, links).values())


@pytest.mark.parametrize("hot", [3, 1000])
def test_simhash_links_on_dense_fingerprints(spark, hot):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {0, (1 << 64) - 1}
    while len(fps) < 240:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 7)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    edges = simhash.link_edges(spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long"), hot_cell=hot).collect()
    pairs = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
    for r in edges:
        assert ((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 4
    found = components(fps, [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in edges])
    assert found == components(fps, pairs)


def test_sharding(spark, docs, none):
    limit = 3000
    out = sharding.assigned(docs.select("doc_id", "text"), limit=limit, spare_bits=1).collect()
    assert len(out) == len(texts())
    size = defaultdict(int)
    for r in out:
        size[r["shard_depth"], r["shard_prefix"]] += len((r["text"] or "").encode())
    for r in out:
        here = size[r["shard_depth"], r["shard_prefix"]]
        assert here == r["shard_bytes"] and r["shard_oversized"] == (here > limit)
    assert any(r["shard_oversized"] for r in out)  # the long texts
    assert sharding.assigned(none.select("doc_id", "text")).count() == 0
    named = sharding.assigned(docs.select("doc_id", "text", F.lit("own").alias("Shard_Depth"), "fp"), limit=limit)
    assert named.columns == ["doc_id", "text", "fp", *sharding.ADDED] and named.where("shard_depth >= 0").count() == len(texts())
    same = spark.createDataFrame([(1, "x" * 100)] * 5, "doc_id long, text string")
    got = sharding.assigned(same, limit=120).collect()
    assert len(got) == 5 and all(r["shard_oversized"] and r["shard_bytes"] == 500 for r in got)


def test_licenses(spark):
    rows = [
        (1, "Licensed under the MIT License. Under the  mit-license!"),
        (2, "Apache License, Version 2.0 ... CC BY NC 4.0"),
        (3, None),
        (4, ""),
        (5, "spdx-license-identifier: GPL-3.0 é " + "word " * 40_000),
        (6, "cc by nc sa 4.0 under the mit license mit license"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(1))
    out = {r["doc_id"]: r for r in licenses.scanned(df).collect()}
    for i, text in rows:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        assert out[i]["n_words"] == len(ws)
        places = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split())
        assert sorted((b["word"], b["label"]) for b in out[i]["base"]) == places
    assert "gpl-3" in {s["label"] for s in out[5]["spans"]} and {s["label"] for s in out[6]["spans"]} >= {"cc-by-nc-sa", "mit"}
    assert licenses.scanned(df.where("false")).count() == 0 and len(licenses.rules()) > 200


def test_containment():
    spans = [(0, 20, "a", 9, 1.0), (5, 10, "b", 5, 0.5), (5, 25, "c", 5, 0.5), (6, 9, "d", 10, 1.0), (0, 20, "e", 9, 0.9)]
    want = [s for i, s in enumerate(spans) if not any(t[0] <= s[0] and t[1] >= s[1] and t[3] >= s[3] and (t[:2] != s[:2] or j < i) for j, t in enumerate(spans) if j != i)]
    assert sorted(licenses.standing(spans)) == sorted(want)


def slow_counts(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    covered = {k for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, none):
    extra = [(900, "one two three four five six seven eight nine " * 4, "bad", 0, 0), (901, "# * | <b>", "bad", 0, 0), (902, "ok " * 25, "bad", 0, 0)]
    both = docs.union(spark.createDataFrame(extra, docs.schema))
    out = host_quality.judged(both.drop("n_words"), ["doc_id"]).collect()
    assert len(out) == both.count()
    by = {r["doc_id"]: r["text"] for r in both.collect()}
    for r in out:
        n, chars, symbols, dup, repeat = slow_counts(by[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n) and not (r["base_failed"] and r["kept"])
        assert r["kept"] or r["base_failed"] or r["soft_failed"]
    kept = host_quality.keep_good(both)
    assert kept.columns == both.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in out if r["kept"])
    assert host_quality.judged(none.drop("n_words"), ["doc_id"]).count() == 0 and host_quality.keep_good(none).count() == 0


def test_urls(spark):
    urls = [(i, f"https://Ads{'ab'[i % 2]}.example.com/en/{i}") for i in range(40)] + [(40, None), (41, "no scheme"), (42, "http://a.example.net/de/81?x"), (43, "http://x.org/es/#a"), (44, "https://fakeexample.com/en/7")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit(0))
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(40)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    out = {r["page_id"]: r for r in url_rules.judged(pages, labels).collect()}
    assert len(out) == len(urls) and (out[40]["host"], out[40]["path"], out[41]["rule"], out[41]["verdict"]) == ("", "", None, "allow")
    assert out[42]["rule"] == "example.net/de/8" and out[43]["rule"] == "org/es/" and out[44]["rule"] == "com/en/"
    assert out[7]["rule"] == "example.com/en/7" and out[7]["verdict"] == "allow" and out[1]["rule"] == "com/en/" and out[1]["verdict"] == "block"
    assert "adsb" in out[1]["mined_rule"] and "adsb" not in str(out[0]["mined_rule"])
    assert url_rules.judged(pages.where("false"), labels).count() == 0
    assert url_rules.judged(pages, labels.where("false")).count() == len(urls)


@pytest.mark.parametrize("dims", [3, 64])
def test_top_k(spark, dims, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, dims)) / 8
    x[50:90] = x[10]  # ties
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(500, None), (520, [math.nan] * dims), (540, [None] * dims), (60, x[10].tolist())]
    monkeypatch.setattr(topk_nra, "SHARD_ROWS", 64)
    monkeypatch.setattr(topk_nra, "BLOCK_QUERIES", 4)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = topk_nra.top_k(table, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=7).collect()
    ints = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows if v and None not in v and not math.isnan(v[0])}
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in (0, 20, 40, 60, 100, 180):
        every = sorted(((i, int(v @ ints[q])) for i, v in ints.items() if i != q), key=lambda p: (-p[1], p[0]))
        seen = [p for p in got[q]]
        assert [s for _, s in seen] == [s for _, s in sorted(every + ([(60, int(ints[60] @ ints[q]))] if q != 60 else []), key=lambda p: (-p[1], p[0]))[:7]]
    assert topk_nra.top_k(table.where("false"), "vec_id", "embedding", F.lit(True)).count() == 0
    odd = [(0, [3e7, -3.0]), (0, [3e7, -3.0]), (1, [2e7, 1.0]), (2, [3e7, 5.0]), (3, [1.0, 2.0, 3.0]), (20, [1.0, 1.0, 1.0])]
    odd = topk_nra.top_k(spark.createDataFrame(odd, "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=6)
    big = 64 * 3 * 10**7
    want = [(0, 1, 2, big * big - 192 * 320), (0, 2, 1, big * 64 * 2 * 10**7 - 192 * 64), (20, 1, 3, 64 * 64 * 6)]
    assert sorted(tuple(r) for r in odd.collect()) == want
    few = topk_nra.top_k(table.where("vec_id < 3"), "vec_id", "embedding", F.col("vec_id") == 0, k=7)
    assert few.count() == 2


def test_mixing(spark, docs, none):
    out = mixing.mixed(docs.drop("size"), ["doc_id"]).collect()
    assert len(out) == len(texts()) and sorted(map(str, out)) == sorted(map(str, mixing.mixed(docs, ["doc_id"]).collect()))
    rows = texts()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(words_of(t))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, target = 1.5 * sum(size.values()), {}
    while True:
        rest = [s for s in order if s not in target]
        free = budget - sum(target.values())
        over = [s for s in rest if free * weight[s] / sum(weight[r] for r in rest) > 2 * size[s]]
        if not over:
            target |= {s: free * weight[s] / sum(weight[r] for r in rest) for s in rest}
            break
        target |= {s: 2 * size[s] for s in over}
    source = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in out:
        assert r["source_size"] == size[source[r["doc_id"]]] and 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]], rel=1e-9)
        taken[source[r["doc_id"]]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 20
    again = mixing.repeat_rows(docs)
    assert again.columns == docs.columns and mixing.repeat_rows(none).count() == 0 and mixing.mixed(none, ["doc_id"]).count() == 0


def test_newton(spark):
    rows = [("a", 100, 3.0), ("b", 100, 199.9999), ("c", 100, 200.0), ("d", 0, 0.0), ("e", 10**9, 1.0)]
    out = mixing.tilts(spark.createDataFrame(rows, "source string, tokens long, target double")).collect()
    for r in out:
        assert r["rate"] == pytest.approx(r["target"] / r["tokens"] if r["tokens"] else 1.0, rel=1e-6)


def slow_lines(rows, threshold=line_dedup.THRESHOLD):
    """Lines that go of each document, by all pairs."""
    seen, sets, places, k = {}, [], [], line_dedup.SHINGLE
    for doc, text, _ in sorted({r[0]: r for r in rows}.values()):
        for pos, line in enumerate(text.split("\n") if text is not None else []):
            norm = line.lower().strip(line_dedup.BLANK)
            if norm:
                if norm not in seen:
                    sets.append({norm[i : i + k] for i in range(max(1, len(norm) - k + 1))})
                    seen[norm] = len(seen)
                places.append((doc, pos, seen[norm]))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold]
    root = components(range(len(sets)), links)
    first = {}
    for doc, pos, i in places:
        first.setdefault(root[i], (doc, pos))
    gone = defaultdict(set)
    for doc, pos, i in places:
        if first[root[i]] != (doc, pos):
            gone[doc].add(pos)
    return gone


def test_line_dedup(spark, docs, none):
    rows = texts()
    changed = rows[10][1].split("\n")
    word = max((w for x in changed for w in x.split(" ")), key=len)
    more = [(200, rows[10][1].replace(word, word + "x", 1), "s", 0, 0), (201, "漢字かな交じり文の長い行です。これは重複しています。" * 2, "s", 0, 0), (202, "漢字かな交じり文の長い行です。これは重複していますよ。" * 2, "s", 0, 0), (None, "kept as it is, whatever else may be said of it", "s", 0, 0)]
    both = docs.union(spark.createDataFrame(more, docs.schema))
    out = line_dedup.deduplicated(both).collect()
    assert len(out) == both.count()
    gone = slow_lines([(r["doc_id"], r["text"], None) for r in both.where("doc_id is not null").collect()])
    text = {r["doc_id"]: r["text"] for r in both.collect()}
    for r in out:
        want = text[r["doc_id"]]
        if r["doc_id"] in gone:
            want = "\n".join(x for i, x in enumerate(want.split("\n")) if i not in gone[r["doc_id"]])
        assert r["text"] == want and r["lines_gone"] == len(gone.get(r["doc_id"], ()))
    assert gone and line_dedup.deduplicated(none).count() == 0


@pytest.mark.parametrize("n,top", [(0, 1), (1, 5), (15, 100), (16, 1000), (1000, 50), (3000, 10**9)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n))
    ef = elias_fano.EliasFano.encode(values)
    at = rng.integers(0, max(n, 1), 50)[: 50 * (n > 0)]
    assert (ef.get(at) == values[at]).all()
    targets = rng.integers(0, top + 2, 100)
    position, value = ef.successor(targets)
    assert (position == np.searchsorted(values, targets)).all()
    inside = position < n
    assert (value[inside] == values[position[inside]]).all()


def test_lm(docs, none):
    out = sorted(lm_scoring.scored(docs).collect(), key=str)
    rows = texts()
    training = [[w.lower() for w in words_of(t)] for i, t, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for ws in training for w in ws)
    n, v = sum(c.values()) + len(training), len(c) + 1
    by = {i: [w.lower() for w in words_of(t)] for i, t, _ in rows}
    assert len(out) == len(rows)
    for r in out:
        ws = by[r["doc_id"]]
        counts = [c[w] for w in ws] + [len(training)]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws) + 1, sum(k > 0 for k in counts), n)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((k + 1) / (n + v + 1)) for k in counts), abs=1e-6)
        assert r["score"] < 0
    train = [r for r in out if not r["held_out"]]
    assert sum(r["score"] for r in train) > sum(r["base_score"] for r in train)
    assert lm_scoring.scored(none).count() == 0


def test_lm_is_a_distribution():
    """Shares and leftover mass of a context add up to one, up to the codes' steps."""
    rng = np.random.default_rng(3)
    t = rng.zipf(1.5, 5000) % 60 + 2
    c2, c3 = Counter(zip(t, t[1:], strict=False)), Counter(zip(t, t[1:], t[2:], strict=False))
    uv, uvw = sorted(c2), sorted(c3)
    at = {k: i for i, k in enumerate(uv)}
    keys, keys3 = [int(a) << 32 | int(b) for a, b in uv], [at[k[:2]] << 32 | int(k[2]) for k in uvw]
    trie = elias_fano.Trie.build(np.array(keys), np.array([c2[k] for k in uv]), np.array(keys3), np.array([c3[k] for k in uvw]), 0.75)
    trie = elias_fano.Trie.frombuffer(np.frombuffer(trie.tobytes(), np.uint8))
    u, v = map(np.array, zip(*uv, strict=True))
    node, count, rest = trie.pair(u, v)
    assert (node == np.arange(len(uv))).all() and np.allclose(count, [c2[k] - 0.75 for k in uv], rtol=0.05)
    every = np.arange(62)
    for j in range(0, len(uv), 7):
        got = trie.triple(np.full(62, j), every)
        assert got.sum() + rest[j] == pytest.approx(1, abs=0.05)
    assert (trie.pair(np.array([70]), np.array([3]))[0] == -1).all()


def slow_scores(rows):
    """log10 probabilities of texts by the definition, from dictionaries of all n-grams."""
    tokens = {i: [w.lower() for w in words_of(t)] + [None] for i, t in rows}
    training = [ws for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c1 = Counter(w for ws in training for w in ws)
    c2 = Counter(k for ws in training for k in zip(ws, ws[1:], strict=False))
    c3 = Counter(k for ws in training for k in zip(ws, ws[1:], ws[2:], strict=False))
    after1, after2 = Counter(k[0] for k in c2), Counter(k[:2] for k in c3)
    n, v = sum(c1.values()), len(c1)
    out = {}
    for i, ws in tokens.items():
        total = 0.0
        for at, w in enumerate(ws):
            p = (c1[w] + 1) / (n + v + 1)
            if at and c1[ws[at - 1]]:
                u = ws[at - 1]
                p = (max(c2[u, w] - 0.75, 0) + 0.75 * after1[u] * p) / c1[u]
            if at > 1 and c2[tuple(ws[at - 2 : at])]:
                uv = tuple(ws[at - 2 : at])
                p = (max(c3[(*uv, w)] - 0.75, 0) + 0.75 * after2[uv] * p) / c2[uv]
            total += math.log10(p)
        out[i] = total
    return out


@pytest.mark.parametrize("head,shard", [(lm_scoring.HEAD, lm_scoring.SHARD_TOKENS), (5, 300)])
def test_lm_scores_follow_the_definition(spark, monkeypatch, head, shard):
    """The head's size and the shards change nothing but the codes' steps."""
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", shard)
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 2000)
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)] + ["x" * 70]
    rows = [(i, " ".join(words[int(k) % 401] for k in rng.zipf(1.3, int(rng.integers(1, 60))))) for i in range(150)]
    rows += [(1000, ""), (1001, None), (1002, "never seen before"), (1003, "w1 " * 3000), (1004, "x" * 70)]
    want = slow_scores([(i, t or "") for i, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r for r in lm_scoring.scored(docs).collect()}
    assert out.keys() == want.keys()
    for i, r in out.items():
        assert r["score"] == pytest.approx(want[i], abs=0.02 * r["n_tokens"])
    assert sum(r["score"] for r in out.values()) == pytest.approx(sum(want.values()), rel=0.005)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    out = packing.packed(docs).collect()
    coder = Tokenizer.from_file(packing.vocabulary_path())
    ids = {i: [*coder.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for i, t, _ in texts()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(part) and bytes(r["ids"]) == part and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    copies = Counter(i for i, _, _ in texts())
    for i, n in copies.items():
        cover = Counter(k for a, m in pieces[i] for k in range(a, a + m))
        assert cover == Counter({k: n for k in range(len(ids[i]))})
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096 and (end == 4096 or end & (end - 1) == 0)
    assert packing.packed(none).count() == 0


@pytest.mark.parametrize("text", ["", " \n\t x  y", "ΑΣΣ ΣΑΣ", "İstanbul I'VE DON'T it's '' 's", "école É́ é. a.b.", "<|endoftext|> a<|startoftext|>b", "a\x1cb\x85c ...,;:)( ½²٣4567", "ﬁ ẞ 你好, 👍🏽é"])
def test_tokens_are_those_of_one_call(text):
    coder = packing.ChunkTokenizer(packing.vocabulary_path(), 4)
    for _ in range(2):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == coder.inner.encode(text, add_special_tokens=False).ids
