"""Buckets whose similar lines are neither neighbours nor like the bucket's first."""

from tessera.llm.line_dedup import BINS, bucket_pairs, mixed_pairs, other_pairs


def test_no_pair_of_a_bucket_is_left_out(spark):
    met = spark.createDataFrame([(7, k, k, 0, 6) for k in range(6)], "key long, o int, k1 long, first long, size long")
    alike, other = [1] * BINS, [2] * BINS
    bins = spark.createDataFrame([(k, alike if k in (1, 4) else [100 + k] * BINS if k != 2 else other) for k in range(6)], "k1 long, bins array<int>")
    roots = spark.createDataFrame([], "k1 long, root long")
    tried = [bucket_pairs(met)]
    tried.append(mixed_pairs(met, roots, tried))
    assert not [r for t in tried for r in t.collect() if (r.a, r.b) == (1, 4)]
    assert [tuple(r) for r in other_pairs(met, roots, bins, tried, 0.8).collect()] == [(1, 4)]
    joined = spark.createDataFrame([(4, 1)], "k1 long, root long")
    assert other_pairs(met, joined, bins, tried, 0.8).isEmpty()
