"""Pairs of 64-bit hashes that differ in few bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def near_hashes(hashes: DataFrame, most: int = 8, blocks: int = 3) -> DataFrame:
    """(x, y, distance) for each two different values x < y of the column ``hash`` that differ in ``most`` bits or fewer, each pair once.

    The bits are dealt to ``blocks`` by turns; in one of them such a pair differs in most // blocks bits at most, of which two are allowed.  A hash stands
    under each block's own bits and, if a block may differ, under those with one bit turned, so a pair that differs in two there meets under both
    words between them: 66 keys of 21 bits with the defaults.  It counts in the first such block, under one of its words, so nothing has to be made
    distinct.  Keys are many times the hashes, which Spark's estimates don't see: the join is by sorting, never broadcast.  Null hashes are ignored.
    """
    apart = most // blocks
    if apart > 2:
        raise ValueError("blocks have to be so many that most // blocks is 2 or less")
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    masks = [signed(sum(1 << bit for bit in range(b, 64, blocks))) for b in range(blocks)]
    turns = [[0, *[signed(1 << bit) for bit in range(b, 64, blocks) if apart]] for b in range(blocks)]
    h = hashes.select("hash").where("hash is not null").distinct()
    words = lambda b: F.transform(F.array(*[F.lit(t) for t in turns[b]]), lambda t: F.struct(F.lit(b).alias("block"), F.col("hash").bitwiseAND(F.lit(masks[b])).bitwiseXOR(t).alias("bits"), t.alias("turn")))
    dealt = h.select("hash", F.inline(F.flatten(F.array(*[words(b) for b in range(blocks)]))))
    x, y = (dealt.select("block", "bits", F.col("hash").alias(n), F.col("turn").alias(f"turn_{n}")).hint("merge") for n in ("x", "y"))
    both = F.col("x").bitwiseXOR(F.col("y"))
    earlier = F.lit(False)
    for b in range(blocks - 1):
        earlier |= (F.col("block") > b) & (F.bit_count(both.bitwiseAND(F.lit(masks[b]))) <= apart)
    one_word = (F.col("turn_x") < F.col("turn_y")) | (F.col("turn_x") == 0) & (F.col("turn_y") == 0)
    within = F.lit(True) if apart != 1 else (F.col("turn_x") == 0) | (F.col("turn_y") == 0)
    met = x.join(y, ["block", "bits"]).where((F.col("x") < F.col("y")) & one_word & within & (F.bit_count(both) <= most) & ~earlier)
    return met.select("x", "y", F.bit_count(both).cast("long").alias("distance"))
