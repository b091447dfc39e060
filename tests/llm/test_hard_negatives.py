"""Hard negatives against a plain loop over all pairs."""

import math

import numpy as np

from tests.llm.test_edges import CLASHES
from tests.llm.test_operators import rows_of

KIND = "vec_id long, embedding array<float>, label int"


def expected(data, positives=5, negatives=5, low=80, high=100, every=10, scale=256):
    one = {}
    for d, v, k in data:
        if d is None or v is None or k is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        one[d] = min(one.get(d, (k, v)), (k, v))
    rows = {d: (k, [math.floor(scale * float(np.float32(x))) for x in v]) for d, (k, v) in one.items()}
    out = []
    for a, (kind, v) in rows.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), d, k) for d, (k, w) in rows.items() if d != a and len(w) == len(v))
        for p, d, _ in [s for s in scores if s[2] == kind][:positives]:
            near = [s for s in scores if s[2] != kind and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out += [(a, d, r + 1, s[1], -p, -s[0]) for r, s in enumerate(near)]
    return sorted(out)


def mined(frame, **options):
    from pyspark.sql import functions as F

    from boxquarry.llm.hard_negatives import mine_negatives

    every = options.pop("every", 10)
    got = rows_of(mine_negatives(frame, F.col("vec_id") % every == 0, **options))
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got)


def table(seed=2, n=150, size=6):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(4, size)) * 0.3 + 0.3
    data = [(k, [float(np.float32(x)) for x in centres[k % 4] + rnd.normal(size=size) * 0.1], int(rnd.integers(0, 3))) for k in range(n)]
    data += [(200 + k, data[20][1], k % 3) for k in range(12)]  # ties
    return data


def test_against_all_pairs(spark):
    from pyspark.sql import functions as F

    odd = [(None, [0.1] * 6, 1), (300, None, 1), (310, [0.1] * 6, None), (320, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1), (330, [float("nan")] * 6, 1), (340, [float("inf")] * 6, 1), (350, [], 2), (360, [], 2), (370, [0.5] * 5, 0), (371, [0.4] * 5, 1), (380, [0.5] * 5, 0)]
    data = table() + odd + table()[:30] + [(40, [0.9] * 6, 0)]
    frame = spark.createDataFrame(data, KIND).select("*", *[F.lit(k).alias(c) for k, c in enumerate([*CLASHES, "anchor", "vec", "of_rows", "place", "score"])]).repartition(3)
    for block in (1 << 13, 64):  # with 64, many blocks of rows and of anchors meet
        assert mined(frame, block=block) == expected(data)
    assert mined(frame, positives=3, negatives=2, low=95, high=99) == expected(data, 3, 2, 95, 99)
    assert mined(frame.limit(0)) == []


def test_scores_beyond_doubles_and_longs(spark):
    rnd = np.random.default_rng(1)
    for size in (1e7, 1e12):
        data = [(k, [float(np.float32(x)) for x in (rnd.random(3) + 0.5) * size], k % 2) for k in range(30)]
        fits = lambda s: s if -(2**63) <= s < 2**63 else None
        assert mined(spark.createDataFrame(data, KIND)) == [(*r[:4], fits(r[4]), fits(r[5])) for r in expected(data)]


def test_negative_scores_have_no_negatives(spark):
    data = [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [-0.9, 0.0], 1)]
    assert mined(spark.createDataFrame(data, KIND)) == []
