"""Hard negatives by a full sort of each anchor's scores.

Anchors are a stated set of rows.  They and all rows are dealt into blocks of bounded size, and every block of anchors meets every
block of rows in a task, so no task and no broadcast grows with the table.  In a meeting, each anchor's scores with the rows of another
label are sorted by (score, id) in full; each positive's upper limit is found there by binary search, and the entries from there on are
read down to the lower limit.  What the blocks have found for one anchor is ranked once more: a few rows a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window as W
from pyspark.sql import functions as F

from boxquarry.llm.storage import cut

#: Doubles hold whole numbers exactly up to the first; longs up to the second; scores in rows are cut to the third.
_EXACT, _LONG, _MOST = 2**53, 2**63, 10**38 - 1
_SCORE = pa.decimal128(38, 0)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: by doubles or longs where they suffice, else by Python's integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    if most < _LONG / 2:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda x: np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)
    return whole(a) @ whole(b).T


def by_score(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The full order of these scores: the highest first, equal ones by smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda k: (-scores[k], ids[k])), dtype=np.int64)
    return np.lexsort((ids, -scores))


def _vectors(rows: pa.Table, scale: int) -> list[np.ndarray]:
    column = rows["vec"].combine_chunks()
    with np.errstate(over="ignore"):
        values = np.floor(np.clip(column.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale, np.finfo(np.float64).min, np.finfo(np.float64).max))
    bounds = column.offsets.to_numpy().tolist()
    return [values[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]


def _scored(anchors: pa.Table, rows: pa.Table, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each anchor that has rows with as long a vector: its place, and these rows' scores, ids and labels."""
    if not anchors.num_rows or not rows.num_rows:
        return
    a, b = _vectors(anchors, scale), _vectors(rows, scale)
    sizes = np.array([len(v) for v in b])
    ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
    for size in sorted({len(v) for v in a}):
        at = np.flatnonzero(sizes == size)
        if len(at):
            theirs = np.stack([b[k] for k in at])
            own = [k for k, v in enumerate(a) if len(v) == size]
            for first in range(0, len(own), 64):
                some = own[first : first + 64]
                for k, scores in zip(some, inner_products(np.stack([a[k] for k in some]), theirs), strict=True):
                    yield k, scores, ids[at], labels[at]


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    value = lambda x, kind: [Decimal(max(-_MOST, min(_MOST, int(v)))) for v in x] if kind == _SCORE else x
    return pa.table([pa.array(value(x, kind), kind) for x, kind in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _positives(most: int, scale: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's first ``most`` other rows of each anchor's label."""

    def meet(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        names, kinds, out = anchors["id"].to_pylist(), anchors["label"].to_pylist(), []
        for k, scores, ids, labels in _scored(anchors, rows, scale):
            same = np.flatnonzero((labels == kinds[k]) & (ids != names[k]))
            first = same[by_score(scores[same], ids[same])[:most]]
            out += [(names[k], int(ids[n]), scores[n]) for n in first]
        return _table(out, anchor=pa.int64(), positive=pa.int64(), score=_SCORE)

    return meet


def _negatives(most: int, low: int, high: int, scale: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's first ``most`` rows of another label within each positive's limits."""

    def meet(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        names, kinds, wanted, out = anchors["id"].to_pylist(), anchors["label"].to_pylist(), anchors["positives"].to_pylist(), []
        for k, scores, ids, labels in _scored(anchors, rows, scale):
            other = np.flatnonzero(labels != kinds[k])
            order = other[by_score(scores[other], ids[other])]
            rising = scores[order[::-1]]
            for p in wanted[k]:
                score = int(p["score"])
                upper = high * score // 100
                if rising.dtype != object:
                    upper = max(-_LONG, min(_LONG - 1, upper))
                start = len(rising) - int(np.searchsorted(rising, upper, side="right"))
                near = [n for n in order[start : start + most] if low * score <= 100 * int(scores[n])]
                out += [(names[k], p["positive"], int(ids[n]), score, scores[n]) for n in near]
        return _table(out, anchor=pa.int64(), positive=pa.int64(), negative=pa.int64(), positive_score=_SCORE, negative_score=_SCORE)

    return meet


def _meetings(anchors: DataFrame, rows: DataFrame, of_anchors: int, of_rows: int) -> GroupedData:
    """Both sides by meeting: each anchor once a block of rows, each row once a block of anchors."""
    own = lambda of: F.pmod(F.xxhash64("id"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    # a number of its own, as the work is in the meetings and not in the bytes; a task holds one meeting at a time
    tasks = min(of_anchors * of_rows, 1 << 14)
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # columns of their own, though both come from one table
    a = anchors.withColumn("of_anchors", own(of_anchors)).withColumn("of_rows", every(of_rows)).repartition(tasks, "of_anchors", "of_rows")
    r = rows.withColumn("of_rows", own(of_rows)).withColumn("of_anchors", every(of_anchors)).repartition(tasks, "of_anchors", "of_rows")
    return a.groupBy("of_anchors", "of_rows").cogroup(r.groupBy("of_anchors", "of_rows"))


def mine_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    block: int = 1 << 13,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that are ``is_anchor``, against all rows.

    Components become floor(scale * x); a score is the integer inner product, exact up to 38 digits, and null in the result where it is
    no long.  Higher scores come first, then smaller ids.  An anchor's positives are its first ``positives`` other rows of its label; for each, the first
    ``negatives`` rows of another label whose score is from ``low`` to ``high`` hundredths of the positive's are ranked from 1.  Rows without id,
    label or vector, or with a component that is null or not finite, take no part.  Of rows with one id, that with the smallest label and
    then the smallest vector takes part.  Vectors of different lengths never meet.  Extra columns are ignored; an empty table has no rows.  A
    meeting holds about ``block`` rows and a sixteenth as many anchors.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col(vector_col).alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    used = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & sound)
    rows = cut(used.groupBy("id").agg(F.min(F.struct("label", "vec", "anchor")).alias("row")).select("id", "row.label", "row.vec", "row.anchor"), "vectors")
    anchors = rows.where("anchor").select("id", "label", "vec")
    rows = rows.drop("anchor")
    blocks = max(1, -(-anchors.count() // max(1, block // 16))), max(1, -(-rows.count() // block))
    found = _meetings(anchors, rows, *blocks).applyInArrow(_positives(positives, scale), "anchor long, positive long, score decimal(38,0)")
    best = found.withColumn("place", F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "positive"))).where(F.col("place") <= positives)
    wanted = cut(best.groupBy(F.col("anchor").alias("id")).agg(F.collect_list(F.struct("positive", "score")).alias("positives")), "positives")
    near = _meetings(anchors.join(wanted, "id"), rows, *blocks).applyInArrow(_negatives(negatives, low, high, scale), "anchor long, positive long, negative long, positive_score decimal(38,0), negative_score decimal(38,0)")
    order = W.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    score = lambda name: F.expr(f"try_cast({name} AS long)").alias(name)
    return ranked.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), score("positive_score"), score("negative_score"))
