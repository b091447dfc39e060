"""Pairs of near hashes against all pairs, with hashes of all 64 bits."""

import random

import pytest


@pytest.mark.parametrize(("most", "blocks"), [(8, 10), (8, 12), (3, 5), (0, 1)])
def test_against_all_pairs(spark, most, blocks):
    from boxquarry.operators.near_hashes import near_hashes

    rnd = random.Random(most)
    values = [rnd.getrandbits(64) for _ in range(40)]
    for v in values[:30]:
        flipped = v
        for bit in rnd.sample(range(64), rnd.randint(1, 11)):
            flipped ^= 1 << bit
        values.append(flipped)
    values += values[:5] + [0, 2**64 - 1, 2**63, 255]
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in [*signed, None]], "hash long")
    got = sorted((r["x"], r["y"], r["distance"]) for r in near_hashes(frame, most, blocks).collect())
    distinct = sorted(set(signed))
    want = [(x, y, n) for k, x in enumerate(distinct) for y in distinct[k + 1 :] for n in [((x ^ y) & (2**64 - 1)).bit_count()] if n <= most]
    assert got == want


@pytest.mark.parametrize(("most", "blocks"), [(8, 3), (8, 4), (5, 3), (2, 3)])
def test_turned_bits_against_all_pairs(spark, most, blocks):
    from boxquarry.operators.near_hashes import near_hashes

    rnd = random.Random(blocks)
    values = [rnd.getrandbits(60) for _ in range(60)]
    for v in values[:50]:
        flipped = v
        for bit in rnd.sample(range(64), rnd.randint(1, 10)):
            flipped ^= 1 << bit
        values.append(flipped)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    got = sorted((r["x"], r["y"], r["distance"]) for r in near_hashes(spark.createDataFrame([(v,) for v in signed], "hash long"), most, blocks).collect())
    distinct = sorted(set(signed))
    assert got == [(x, y, n) for k, x in enumerate(distinct) for y in distinct[k + 1 :] for n in [((x ^ y) & (2**64 - 1)).bit_count()] if n <= most]


def test_keys_are_not_broadcast(spark):
    """Spark takes the keys, many to a hash, for as small as the hashes."""
    from boxquarry.operators.near_hashes import near_hashes

    plan = near_hashes(spark.range(1000).withColumnRenamed("id", "hash"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
