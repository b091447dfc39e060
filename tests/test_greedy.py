"""Greedy covers and capped passes against plain loops, with heads of all sizes."""

import hashlib
import random
from collections import Counter

import pytest


def hashed(seed, item):
    return hashlib.sha256(f"{seed}:{item}".encode()).hexdigest()


def plain_cover(counts, target, most=0, seed="cover"):
    vectors = {}
    for item, key, n in counts:
        vectors.setdefault(item, Counter())[key] += n
    have, left, out = Counter(), dict(vectors), []
    while left and (not most or len(out) < most):
        best = None
        for item, v in left.items():
            gain = sum(min(target - have[k], n) * (2 * target - have[k]) for k, n in v.items() if have[k] < target)
            if gain > 0 and (best is None or (-gain, hashed(seed, item)) < best[:2]):
                best = (-gain, hashed(seed, item), item)
        if best is None:
            break
        out.append((len(out) + 1, best[2], -best[0]))
        have.update(left.pop(best[2]))
    return out


@pytest.mark.parametrize("head", [1, 3, 4096])
def test_greedy_cover(spark, head):
    from boxquarry.operators.greedy import greedy_cover

    rnd = random.Random(head)
    counts = [(i, k, rnd.choice([1, 1, 1, 2, 9])) for i in range(60) for k in rnd.sample("abcdef", rnd.randint(1, 2))]
    frame = spark.createDataFrame([*counts, (99, None, 4)], "image long, key string, n long")
    for target, most in ((3, 0), (12, 0), (5, 4), (400, 0)):
        if head == 1 and target == 400:
            continue
        got = [tuple(r) for r in greedy_cover(frame, "image", "key", target, most, head=head).orderBy("step").collect()]
        assert got == plain_cover(counts, target, most)
    assert greedy_cover(frame.limit(0), "image", "key", 5).collect() == []


@pytest.mark.parametrize("head", [1, 7, 1024])
def test_capped_pass(spark, head):
    from pyspark.sql import functions as F

    from boxquarry.operators.greedy import CappedPass

    rnd = random.Random(3)
    rows = [(i, i // 2, rnd.randint(0, 9), rnd.choice("xyz"), sorted(set(rnd.choices("abcd", k=rnd.randint(0, 3)))) if i % 11 else None) for i in range(120)]
    frame = spark.createDataFrame(rows, "image long, canonical long, score long, source string, classes array<string>").repartition(3)
    keys = F.concat(F.array(F.concat(F.lit("source:"), "source")), F.coalesce(F.transform("classes", lambda c: F.concat(F.lit("class:"), c)), F.array().cast("array<string>")))
    run = CappedPass(most=40)
    took = [run.run(frame.where(where), "image", [-F.col("score"), F.col("image")], {"source": cap, "class": cap - 2}, keys, once="canonical", bucket=name, most=most, fresh=fresh, head=head) for name, where, cap, most, fresh in (("high", "score > 4", 9, 12, True), ("any", "true", 12, None, True), ("rest", "true", 14, None, False))]
    want, seen = [], set()
    counts = Counter()
    for name, least, cap, most, fresh in (("high", 5, 9, 12, True), ("any", 0, 12, 1000, True), ("rest", 0, 14, 1000, False)):
        counts = Counter() if fresh else counts
        n = 0
        for i, c, score, source, classes in sorted(rows, key=lambda r: (-r[2], r[0])):
            own = [("s", source), *((("c", k)) for k in classes or [])]
            if score < least or n >= most or len(want) >= 40 or c in seen or any(counts[k] >= (cap if k[0] == "s" else cap - 2) for k in own):
                continue
            n += 1
            seen.add(c)
            counts.update(own)
            want.append((len(want) + 1, name, i))
    assert [tuple(r) for r in run.result(frame, "image").orderBy("step").collect()] == want and sum(took) == len(want)


def test_an_underfilled_class_is_an_error(spark):
    from boxquarry.plans.passes import balanced_eval

    rows = spark.createDataFrame([(i, [i % 3] if i % 5 else []) for i in range(60)], "image long, classes array<long>")
    got = Counter(r["bucket"] for r in balanced_eval(rows, [0, 1, 2], 6, 4, "x").collect())
    assert got == {"class": 18, "background": 4}
    with pytest.raises(Exception, match="underfilled class ids: 0, 1, 2, 7"):
        balanced_eval(rows, [0, 1, 2, 7], 17, 4, "x").collect()
