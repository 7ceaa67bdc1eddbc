"""Combinations that turn bad at five tokens only make a rule."""

from itertools import combinations

from tessera.llm import url_rules


def test_rule_of_five_tokens(spark):
    tokens = [f"p:{x}" for x in "abcde"]
    rows = [(tokens, True)] * 20 + [(list(c), False) for c in combinations(tokens, 4) for _ in range(20)]
    rules = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert [r["tokens"] for r in rules] == [tokens] and rules[0]["confidence"] == 1.0
