"""Selections that are defined by a sequential pass: greedy covers, and lists with caps on several keys.

Both are exact.  Spark ranks all rows and hands the driver a bounded head of them, together with a bound on what the others can be
worth; the pass goes on over that head for as long as nothing outside it can come next, and then Spark ranks what is left again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from boxquarry.operators.selection import hash_order
from boxquarry.sources.scratch import cut


def greedy_cover(counts: DataFrame, item: str, key: str, target: int, most: int = 0, seed: str = "cover", head: int = 4096) -> DataFrame:
    """(step, item, gain): items that cover each key ``target`` times, the largest gain first.

    ``counts`` has one row (item, key, n) for each key of an item, n >= 1.  A key that still lacks d of its target adds min(d, n) * (target + d) to an
    item's gain, which is the score min(d, n) * (1 + d / target) in whole numbers.  Equal gains go to the smaller SHA-256 of seed and item.  It
    ends when no item gains, or after ``most`` steps, if not 0.  Rows with a null key are ignored; no rows: no steps.

    Items of equal counts are one row with their first ``target`` hashes, as a step takes at least one off all that its keys lack.  A gain can
    only fall, so the gain at the last ranking bounds that of a row outside the ``head`` best ones.  The driver holds these, one number for each key,
    and the steps, of which there are at most ``target`` times the keys.
    """
    spark, kind = counts.sparkSession, counts.schema[item].dataType.simpleString()
    counts = counts.select(F.col(item).alias("item"), F.col(key).cast("string").alias("key"), F.least(F.col("n").cast("long"), F.lit(target)).alias("n")).where("key is not null and n > 0")
    keys = [r[0] for r in counts.select("key").distinct().orderBy("key").collect()]
    if not keys:
        return spark.createDataFrame([], f"step long, {item} {kind}, gain long")
    place = F.create_map(*[F.lit(x) for k, name in enumerate(keys) for x in (name, k)])
    own = counts.groupBy("item").agg(F.array_sort(F.collect_list(F.struct(place[F.col("key")].alias("k"), "n"))).alias("vector")).withColumn("h", hash_order(seed, "item"))
    sizes = own.groupBy("vector").agg(F.count("*").alias("size"))
    # Spark applies the window's limit before the shuffle
    first = own.withColumn("r", F.row_number().over(W.partitionBy("vector").orderBy("h"))).where(F.col("r") <= target)
    table = cut(first.groupBy("vector").agg(F.array_sort(F.collect_list(F.struct("h", "item"))).alias("items")).join(sizes, "vector"), "cover")
    deficits, chosen, used = np.full(len(keys), target, dtype=np.int64), [], {}
    more = lambda: not most or len(chosen) < most
    while deficits.any() and more():
        lack = F.array(*[F.lit(int(d)).cast("long") for d in deficits])
        gain = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + F.least(x["n"], lack[x["k"]]) * (lack[x["k"]] + target))
        times = F.create_map(*[F.lit(x) for pair in used.items() for x in pair])[F.col("items")[0]["h"]] if used else F.lit(None).cast("int")
        left = table.withColumn("t", F.coalesce(times, F.lit(0))).where("t < size").withColumn("gain", gain).where("gain > 0")
        rows = left.withColumn("next", F.get("items", F.col("t"))["h"]).orderBy(F.desc("gain"), "next").limit(head + 1).collect()
        if not rows:
            break
        # what any row outside the head may be worth, in the order of steps: a larger gain first, then a smaller hash
        outside = (-rows[-1]["gain"], rows[-1]["next"]) if len(rows) > head else (0, "")
        rows = rows[:head]
        vectors = np.zeros((len(rows), len(keys)), dtype=np.int64)
        for n, r in enumerate(rows):
            for x in r["vector"]:
                vectors[n, x["k"]] = x["n"]
        at = [r["t"] for r in rows]
        while more():
            gains = (np.minimum(vectors, deficits) * (target + deficits)).sum(axis=1)
            best = int(gains.max())
            if best <= 0:
                break
            n = min(np.flatnonzero(gains == best).tolist(), key=lambda n: rows[n]["items"][at[n]]["h"])
            pick = rows[n]["items"][at[n]]
            if (-best, pick["h"]) >= outside:
                break
            chosen.append((len(chosen) + 1, pick["item"], best))
            at[n] += 1
            used[rows[n]["items"][0]["h"]] = at[n]
            deficits = np.maximum(deficits - vectors[n], 0)
            if at[n] >= rows[n]["size"]:
                vectors[n] = 0
    return spark.createDataFrame(chosen, f"step long, {item} {kind}, gain long")


class CappedPass:
    """A pass over rows in a stated order that takes each row unless one of its keys is full; exact, with counts kept over several passes.

    ``run`` reads the rows that no full key blocks, a bounded head of them at a time, and goes on after the last one read: another
    head is needed only when a key has filled, so a run reads about as many heads as keys fill, however many rows there are.  What it takes is
    bounded by the caps.
    """

    def __init__(self, most: int | None = None):
        self.most, self.counts, self.seen, self.taken = most, {}, set(), []

    def run(
        self,
        rows: DataFrame,
        item: str,
        order: Sequence[Column],
        caps: Mapping[str, int],
        keys: Column,
        counted: Column | None = None,
        once: str | None = None,
        bucket: str = "",
        most: int | None = None,
        until: tuple[str, int] | None = None,
        fresh: bool = False,
        head: int = 1024,
    ) -> int:
        """Takes rows of ``rows`` in ``order`` (a total one), and returns how many.

        ``keys``: an array of keys "kind:name" that block a row once one is full, which ``caps`` says by kind; ``counted``: the keys that a taken row
        counts for, ``keys`` if not given.  No value of ``once`` (``item`` if not given) is taken twice, in earlier passes neither.  The pass ends after ``most`` rows, after the
        object's ``most`` in all, or when the key of ``until`` has its number; ``fresh`` forgets earlier counts first.  Null keys are ignored.
        """
        if fresh:
            self.counts = {}
        once = once or item
        names = [f"o{k}" for k in range(len(order))]
        base = rows.select(F.col(item).alias("item"), F.col(once).alias("once"), F.struct(*[c.alias(n) for c, n in zip(order, names, strict=True)]).alias("at"), keys.alias("keys"), (keys if counted is None else counted).alias("counted"))
        kinds = {f.name: f.dataType for f in base.schema["at"].dataType.fields}
        full = lambda key: key is not None and self.counts.get(key, 0) >= caps.get(key.split(":", 1)[0], 1 << 62)
        began, after = len(self.taken), None
        done = lambda: (most is not None and len(self.taken) - began >= most) or (self.most is not None and len(self.taken) >= self.most) or (until is not None and self.counts.get(until[0], 0) >= until[1])
        while not done():
            left = base
            if after is not None:
                left = left.where(F.col("at") > F.struct(*[F.lit(after[n]).cast(kinds[n]).alias(n) for n in names]))
            blocked = sorted(k for k in self.counts if full(k))
            if blocked:
                left = left.where(~F.arrays_overlap(F.array_compact("keys"), F.array(*[F.lit(k) for k in blocked])))
            found = left.orderBy("at").limit(head).collect()
            for r in found:
                if done():
                    break
                if r["once"] in self.seen or any(full(k) for k in r["keys"] or []):
                    continue
                self.seen.add(r["once"])
                self.taken.append((len(self.taken) + 1, bucket, r["item"]))
                for k in r["counted"] or []:
                    if k is not None:
                        self.counts[k] = self.counts.get(k, 0) + 1
            if len(found) < head:
                break
            after = found[-1]["at"].asDict()
        return len(self.taken) - began

    def result(self, like: DataFrame, item: str) -> DataFrame:
        """(step, bucket, item) of all rows taken, in their order; as many as the caps allow at most."""
        return like.sparkSession.createDataFrame(self.taken, f"step long, bucket string, {item} {like.schema[item].dataType.simpleString()}")
