"""The shard index against plain BM25."""

import math
import random

import numpy as np

from tessera.llm.packing import B, K1, Index


def test_scores():
    rng = random.Random(4)
    for top in (300, 60_000, 2**32 - 1):
        docs = [np.array([min(top, int(rng.paretovariate(0.4))) for _ in range(rng.randint(1, 80))] + [2], "<u4") for _ in range(90)]
        index, mean = Index(docs), sum(map(len, docs)) / len(docs)
        sets = [set(d.tolist()) for d in docs]
        for q in (0, 41, 89):
            want = np.zeros(len(docs))
            for t in sets[q]:
                df = sum(t in s for s in sets)
                for i, d in enumerate(docs):
                    tf = int((d == t).sum())
                    want[i] += math.log1p((len(docs) - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(d) / mean))
            assert np.allclose(index.scores(q), want)
