"""Runs of equal keys in range-partitioned, sorted rows, and the seams between partitions.

A run of equal keys may go on over several partitions, so a hot key needs no single task.  Each
partition reports its first and its last run (one row if they are the same): two rows for each
partition at most, however many rows there are, so one task can order them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F


def chain_seams(seams: DataFrame) -> DataFrame:
    """Adds ``chain``: the same number for seam rows that belong to one run.

    ``seams`` has part (partition number), run (number of the run in it) and key.
    """
    order = W.orderBy("part", "run")
    before = F.lag("key").over(order)
    fresh = F.when(before.isNull() | (before != F.col("key")), 1).otherwise(0)
    return seams.withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(order)).drop("fresh")
