"""Values that hang on exact arithmetic: the generator of resamples, and hashed term vectors."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from quern.functions import tokens
from quern.operators import evaluation, retrieval


def drawn(seed, n):
    out = []
    for _ in range(n):
        seed = (1_664_525 * seed + 1_013_904_223) % 2**32
        out.append(seed / 2**32)
    return out


def test_the_generator():
    assert evaluation.uniform(0, 2).tolist() == [1_013_904_223 / 2**32, (1_664_525 * 1_013_904_223 + 1_013_904_223) % 2**32 / 2**32]
    assert evaluation.uniform(42, 50).tolist() == drawn(42, 50)


@pytest.mark.parametrize("statistic", ["mean", "p95"])
def test_intervals_equal_plain_resampling(spark, statistic):
    rng = np.random.default_rng(8)
    groups = {1: rng.normal(5, 2, 37).round(3).tolist(), 2: [4.0], 3: rng.random(80).round(3).tolist()}
    rows = [(g, i, v) for g, vs in groups.items() for i, v in enumerate(vs)]
    got = {r.group: (r.low, r.high) for r in evaluation.bootstrap(spark.createDataFrame(rows[::-1], "group long, position long, value double"), statistic, 60, 7).collect()}
    for g, vs in groups.items():
        numbers, stats = iter(drawn(7, 60 * len(vs))), []
        for _ in range(60):
            own = sorted(vs[int(next(numbers) * len(vs))] for _ in vs)
            stats.append(sum(own) / len(own) if statistic == "mean" else own[math.ceil(len(own) * 0.95) - 1])
        stats.sort()
        assert got[g] == pytest.approx((stats[math.ceil(60 * 0.025) - 1], stats[math.ceil(60 * 0.975) - 1]), abs=1e-6)


def test_hashed_vectors_equal_plain_hashing(spark):
    texts = {1: "apple pear apple", 2: "", 3: "年假 policy", 4: None, 5: "Ⅳ ABC abc 12"}
    got = {r.id: r.embedding for r in retrieval.hash_embed(spark.createDataFrame(list(texts.items()), "id long, content string"), 384).collect()}
    for i, text in texts.items():
        want = [0.0] * 384
        for term, n in Counter(tokens.tokenize(text or "")).items():
            a, b = (value for value, _ in tokens.ROLLING)
            for c in term:
                a, b = ((x ^ ord(c)) * m % 2**32 for x, (_, m) in zip((a, b), tokens.ROLLING, strict=True))
            want[(a >> 16) % 384] += (-1 if b & 1 << 24 else 1) * (1 + math.log(n))
        length = math.sqrt(sum(x * x for x in want))
        assert got[i] == pytest.approx([x / length if length else 0.0 for x in want])
        assert sum(x * x for x in got[i]) == pytest.approx(1.0 if (text or "").strip() else 0.0)
    assert tokens.tokenize("Ⅳ 年假") == ["iv", "年", "假", "年假"]
