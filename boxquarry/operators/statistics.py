"""Summaries, differences between groups, and distances between sets of vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxquarry.operators.selection import running_totals


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float], linear: bool = True) -> DataFrame:
    """A row for each group with values: by, and under each name of ``shares`` the exact quantile at that share.

    ``linear`` interpolates at place (n - 1) * share, as SQL's continuous percentile does; else it is the value at that place, rounded with
    halves to even.  Equal values are counted before the shuffle and summed up by sorted ranges, so no task holds a group.  Null values
    don't count; nulls in ``by`` are a group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_count"))
    placed = running_totals(counts, [*[F.col(c) for c in by], F.col("_v")], "_count", "_before")
    groups = placed.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(F.min("_before").alias("_start"), F.sum("_count").alias("_total"))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = placed.join(groups, same) if by else placed.crossJoin(F.broadcast(groups))
    after = F.col("_before") - F.col("_start") + F.col("_count")
    first = lambda place: F.min(F.when(after > place, F.col("_v")))
    found = []
    for name, share in shares.items():
        place = (F.col("_total") - 1) * F.lit(share)
        if linear:
            found += [first(F.floor(place)).alias(f"_lo_{name}"), first(F.ceil(place)).alias(f"_hi_{name}"), F.max(place - F.floor(place)).alias(f"_part_{name}")]
        else:
            found.append(first(F.bround(place, 0)).alias(name))
    out = joined.groupBy(*by).agg(*found)
    if not linear:
        return out
    return out.select(*by, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n) for n in shares])


def numeric_summary(rows: DataFrame, by: Sequence[str], columns: Sequence[str], digits: int = 6) -> DataFrame:
    """For each group and column: count, mean, sample deviation (null for one value), and linear 5th, 50th and 95th percentiles."""
    long = rows.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])))
    out = long.groupBy(*by, "metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("stdev"))
    names = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    found = with_quantiles(out, quantiles(long, [*by, "metric"], "v", names), [*by, "metric"])
    return found.select(*by, "metric", "n", *[F.round(c, digits).alias(c) for c in ("mean", "stdev", *names)])


def with_quantiles(groups: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """``groups`` with the columns of ``found``, which has a row for each group at most; nulls in ``by`` match."""
    right = found.withColumnsRenamed({c: f"_q_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    return groups.join(right, same, "left").drop(*[f"_q_{c}" for c in by])


def nearest_rank(value: str, share: float) -> Column:
    """The sorted value at place round((n - 1) * share), halves to even; null without values.  For small groups: one task holds a group's values."""
    held = F.array_sort(F.collect_list(value))
    at = F.bround((F.size(held) - 1) * F.lit(share), 0).cast("int") + 1
    return F.when(F.size(held) > 0, F.element_at(held, F.greatest(at, F.lit(1))))


def mean_delta(rows: DataFrame, by: Sequence[str], family: str, one: str, other: str, value: str, digits: int = 6) -> DataFrame:
    """Means of two families in each group, and their difference; null where a family has no rows."""
    mean = lambda f: F.avg(F.when(F.col(family) == f, F.col(value)))
    out = rows.groupBy(*by).agg(mean(one).alias("a"), mean(other).alias("b"))
    return out.select(*by, F.round("a", digits).alias(f"mean_{one}"), F.round("b", digits).alias(f"mean_{other}"), F.round(F.col("a") - F.col("b"), digits).alias("delta"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, v: t + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 0 if either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm).otherwise(F.lit(0.0))


def centroids(rows: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """The mean vector of each group: places are averaged with partial aggregation, then put together."""
    at = rows.select(*by, F.posexplode(vector).alias("place", "v")).groupBy(*by, "place").agg(F.avg(F.col("v").cast("double")).alias("v"), F.count("*").alias("n"))
    return at.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("centroid"))


def balance(counts: DataFrame, dim: DataFrame, key: str, count: str) -> DataFrame:
    """Least, most, spread and ratio of the counts over all of ``dim``, absent keys counting 0; the ratio is null if the least is 0."""
    full = dim.select(key).join(counts, key, "left").fillna(0, [count])
    out = full.agg(F.min(count).alias("least"), F.max(count).alias("most"))
    return out.select("least", "most", (F.col("most") - F.col("least")).alias("spread"), F.round(F.try_divide(F.col("most").cast("double"), F.col("least")), 6).alias("ratio"))
