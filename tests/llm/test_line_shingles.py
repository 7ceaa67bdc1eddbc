"""Line dedup against all pairs, by the Jaccard similarity of all character shingles."""

import os
import random
from collections import Counter, defaultdict

import pytest

from tessera.llm import line_dedup

SF = "/root/testdata/sf0.001"


def slow_gone(rows):
    """(doc_id, pos) of the lines that go, by all pairs of lines that aren't blank."""
    k, seen, places = line_dedup.SHINGLE, {}, []
    for doc, text in sorted(rows):
        for pos, line in enumerate(text.split("\n")):
            norm = line.lower().strip(line_dedup.BLANK)
            if norm:
                places.append((doc, pos, seen.setdefault(norm, len(seen))))
    sets = [{x[i : i + k] for i in range(max(1, len(x) - k + 1))} for x in seen]
    root = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            if root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root = [root[a] if r == root[b] else r for r in root]
    first = {}
    for doc, pos, i in places:
        first.setdefault(root[i], (doc, pos))
    return {(doc, pos) for doc, pos, i in places if first[root[i]] != (doc, pos)}


def test_all_character_shingles(spark):
    rng = random.Random(8)
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(a, b)))
    rows = []
    for _ in range(60):
        words = [word(2, 14) for _ in range(rng.randint(12, 24))]
        short = min(range(len(words)), key=lambda i: len(words[i]))
        other, longer = list(words), list(words)
        other[short] = "zz"
        at = max(range(len(words)), key=lambda i: len(words[i]))
        longer[at] = longer[at][:8] + "qrstuvwxyz" * 3
        rows += [" ".join(words), " ".join(other), " ".join(longer)]
    rows += [f"the pages of this {'long ' * n}documentation {i}" for n in (0, 3, 9) for i in range(3)]
    rows += ["documentationoftheveryfirstkind andofthelastkind", "documentXXXXXXXXXXXXXXXXXXXXXXX andofthelastkind"]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = defaultdict(int, {r["doc_id"]: r["lines_gone"] for r in line_dedup.deduplicated(docs).collect()})
    assert {(i, 0) for i, n in found.items() if n} == slow_gone(rows)


def gone_of(out):
    return {r["doc_id"]: r["lines_gone"] for r in out.collect()}


def test_lines_that_only_look_alike_stay(spark):
    lines = ["project identifiers internationally", "project identifier internationalization"]
    lines += [f"the pages of this documentation {i}" for i in (7, 8)] + ["----------", "=" * 200]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    want = Counter(doc for doc, _ in slow_gone(list(enumerate(lines))))
    assert gone_of(line_dedup.deduplicated(docs)) == {i: want[i] for i in range(len(lines))}


def test_few_distinct_shingles_and_short_lines(spark):
    lines = ["=" * 90, "=" * 400, "ab" * 300, "ab" * 310, "}", "}", "\t }\r", "ok", "no", "", " ", "", "漢字かな交じり文", "漢字かな交じり文"]
    rows = list(enumerate(lines))
    want = Counter(doc for doc, _ in slow_gone(rows))
    assert gone_of(line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))) == {i: want[i] for i in range(len(lines))}


def test_clashing_names_and_repeated_ids(spark):
    rows = [(1, "a line that stands twice", 5, 6), (1, "another text of the same number", 5, 6), (2, "a line that stands twice\nits own", 5, 6), (None, "a line that stands twice", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines_gone int, Lines_Left int")
    out = line_dedup.deduplicated(docs)
    assert out.columns == ["doc_id", "text", "lines_gone", "lines_left"]
    assert sorted(map(str, ((r.doc_id, r.text, r.lines_gone) for r in out.collect()))) == sorted(
        map(str, [(1, rows[0][1], 0), (1, rows[1][1], 0), (2, "its own", 1), (None, rows[3][1], 0)])
    )
    kept = line_dedup.keep_lines(docs.union(spark.createDataFrame([(3, "a line that stands twice", 1, 1)], docs.schema)))
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "None"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_recall_on_documents(spark):
    """Lines that go, against all pairs, over the whole table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = Counter(doc for doc, _ in slow_gone([(r.doc_id, r.text) for r in docs.where("text is not null").collect()]))
    found = {k: n for k, n in gone_of(line_dedup.deduplicated(docs)).items() if n}
    assert all(n <= want[k] for k, n in found.items()) and sum(found.values()) >= 0.99 * sum(want.values())
