"""A host whose documents fail soft rules only is bad; its clean documents stay."""

import random

import pytest

from tessera.llm import host_quality

RNG = random.Random(4)
SPOILT = {
    "symbols": lambda ws: " ".join(w + " #" for w in ws),
    "dup_lines": lambda ws: "\n".join([" ".join(ws), *["a line again"] * 3]),
    "long_mean": lambda ws: " ".join(w * 5 for w in ws),
}


def words():
    return ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(4, 8))) for _ in range(30)]


@pytest.mark.parametrize("rule", SPOILT)
@pytest.mark.parametrize("others", [1, 8])
def test_soft_failing_host(spark, rule, others):
    rows = [(1000 * h + i, " ".join(words()), f"good{h}") for h in range(others) for i in range(30)]
    rows.append((999, SPOILT[rule](words()), "good0"))
    spoilt = [(90_000 + i, SPOILT[rule](words()), "spam") for i in range(26)]
    clean = [(95_000 + i, " ".join(words()), "spam") for i in range(4)]
    docs = spark.createDataFrame([*rows, *spoilt, *clean], "doc_id long, text string, source string").repartition(3)
    want = {r[0] for r in [*rows, *clean]}
    assert {r["doc_id"] for r in host_quality.keep_good(docs).collect()} == want
    out = {r["doc_id"]: r for r in host_quality.judged(docs, ["doc_id"]).collect()}
    assert {i for i, r in out.items() if r["kept"]} == want
    assert not any(r["base_failed"] for r in out.values()) and all(out[r[0]]["soft_failed"] for r in spoilt)
    assert out[90_000]["host_rate"] > 0.5 > out[1]["host_rate"]
