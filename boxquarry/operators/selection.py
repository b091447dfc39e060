"""Deterministic sampling, ranking and mixing of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from boxquarry.sources.scratch import cut

FEW_GROUPS = 10_000


def hash_order(seed: str, *keys: str) -> Column:
    """A fixed pseudo-random order: SHA-256 of the seed and the keys."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]), 256)


def top_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column], most: int, rank: str | None = None) -> DataFrame:
    """The first ``most`` rows of each group in this order.  Spark drops rows beyond the limit before the shuffle."""
    name = rank or "_rank"
    out = rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)
    return out if rank else out.drop(name)


def capped_top(rows: DataFrame, by: Sequence[str], order: Sequence[Column], cap: int, most: int) -> DataFrame:
    """The first ``most`` rows in this order with at most ``cap`` of each group."""
    return top_per_group(rows, by, order, cap).orderBy(*order).limit(most)


def spread(rows: DataFrame, by: Sequence[str], order: Sequence[Column], count: int) -> DataFrame:
    """``count`` rows of each group at even steps of this order, the first and the last among them; whole smaller groups.

    Step i of k among n rows is row round(i * (n - 1) / (k - 1)), halves to even.
    """
    numbered = number_in_groups(rows, by, order, "_at", "_n")
    at = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(max(count - 1, 1)), 0).cast("long"))
    return numbered.where((F.col("_n") <= count) | F.array_contains(at, F.col("_at").cast("long"))).select(*rows.columns)


def first_of_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in this order."""
    return top_per_group(rows, key, order, 1)


def repeat_rows(rows: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times, with ``copy`` from 1; rows of fewer than one time go."""
    return rows.where(times >= 1).withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int"))))


def cycle_join(left: DataFrame, right: DataFrame, left_order: Sequence[Column], right_order: Sequence[Column]) -> DataFrame:
    """Row i of ``left`` with row i mod n of ``right``: both sides are numbered by range-partitioned counts, not in one task."""
    n = right.count()
    if not n:
        return left.join(right, F.lit(False))
    a, b = number_rows(left, left_order, "_i"), number_rows(right, right_order, "_j")
    return a.withColumn("_j", F.pmod(F.col("_i"), F.lit(n))).join(b, "_j").drop("_i", "_j")


def _in_ranges(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows`` sorted by range partitions and written, so that each row's partition, ``_part``, and its place there, by ``_at``, are fixed."""
    names = [f"_o{k}" for k in range(len(order))]
    dealt = rows.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)]).repartitionByRange(*names).sortWithinPartitions(*names)
    placed = cut(dealt.drop(*names).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    return placed.withColumn("_part", F.shiftright("_at", 33))


def number_rows(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` numbered from 0 in this total order: places in a range partition, after the counts of those before it."""
    placed = _in_ranges(rows, order)
    # one row for each partition
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_before")


def running_totals(rows: DataFrame, order: Sequence[Column], weight: str, name: str) -> DataFrame:
    """``rows`` with the total of ``weight``, a whole number, over all rows before each in this total order; a task sums one range of rows."""
    placed = _in_ranges(rows, order)
    # one row for each partition
    sums = placed.groupBy("_part").agg(F.sum(weight).alias("_n"))
    before = sums.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_earlier"))
    inside = F.sum(weight).over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    out = placed.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_earlier") + F.col("_inside")).drop("_part", "_at", "_inside", "_earlier")


def number_in_groups(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, size: str) -> DataFrame:
    """``rows`` numbered from 0 within each group in this order, with the group's ``size``; no group is held by one task.

    Nulls in ``by`` form no group and go.  Starts of up to FEW_GROUPS groups are broadcast; those of more are joined, where Spark may split a hot group.
    """
    numbered = number_rows(rows, [*[F.col(c) for c in by], *order], "_all")
    starts = cut(numbered.groupBy(*by).agg(F.min("_all").alias("_start"), F.count("*").alias(size)), "starts")
    # a join by few groups would put each of them into one task
    if starts.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        starts = F.broadcast(starts)
    return numbered.join(starts, list(by)).withColumn(name, F.col("_all") - F.col("_start")).drop("_all", "_start")


def apportion(weights: DataFrame, total: int, name: str, weight: str) -> DataFrame:
    """Whole shares of ``total`` in proportion to ``weight``: the largest quotients weight / (k + 0.5) get the seats.

    Ties go to the smaller name.  ``weights`` has one row for each class.
    """
    seats = weights.withColumn("_seat", F.explode(F.sequence(F.lit(0), F.lit(total - 1)))).withColumn("_quotient", F.col(weight) / (F.col("_seat") + 0.5))
    won = seats.orderBy(F.desc("_quotient"), name, "_seat").limit(total).groupBy(name).agg(F.count("*").alias("seats"))
    return weights.select(name, weight).join(won, name, "left").fillna(0, ["seats"])


def exact_sample(rows: DataFrame, order: Sequence[Column], count: int) -> DataFrame:
    """The first ``count`` rows in this order; a table with fewer raises when it is read."""
    drawn = rows.orderBy(*order).limit(count)
    enough = drawn.agg(F.assert_true(F.count("*") == count, F.lit(f"fewer than {count} rows")).alias("_ok"))
    return drawn.crossJoin(F.broadcast(enough)).where("_ok is null").drop("_ok")
