"""How far two domains of feature vectors are apart.

Rows are (id, domain, x) with domain 0 or 1 and x an array of doubles, all of one length.  What needs all pairs is done by
meetings of blocks of bounded size, one task at a time holding two blocks, and no pair is written but those next to a median.  What
needs sums of products is one bounded array for each task, added up by place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from boxquarry.operators.selection import hash_order, number_in_groups, running_totals
from boxquarry.sources.scratch import cut


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of an Arrow column of lists of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def summed(rows: DataFrame, sums: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of an array of fixed length over all batches of rows: one array a task, added up by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                own = sums(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    placed = rows.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("k", "v"))
    found = placed.groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")  # as many rows as the array is long
    return found["v"].to_numpy()


def standardise(rows: DataFrame) -> DataFrame:
    """Each feature less its mean, over its population's standard deviation; a feature that doesn't vary becomes 0."""
    size = _width(rows)
    if not size:
        return rows
    total = summed(rows.select("x"), lambda b: np.append(len(b), matrix(b["x"]).sum(axis=0)))
    mean = total[1:] / total[0]
    spread = np.sqrt(summed(rows.select("x"), lambda b: ((matrix(b["x"]) - mean) ** 2).sum(axis=0)) / total[0])
    scale = np.where(spread > 1e-12, spread, 1.0)
    literal = lambda values: F.array(*[F.lit(float(v)) for v in values])
    z = F.transform(F.arrays_zip("x", literal(mean).alias("m"), literal(scale).alias("s")), lambda t: (t["x"] - t["m"]) / t["s"])
    return rows.withColumn("x", z)


def _width(rows: DataFrame) -> int:
    first = rows.select(F.size("x").alias("n")).first()
    return first["n"] if first else 0


# ---- centroids and covariances ----


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows and means of both domains."""
    total = summed(rows.select("domain", "x"), lambda b: np.concatenate([np.append(k.sum(), matrix(b["x"])[k].sum(axis=0)) for k in _domains(b)]))
    total = total.reshape(2, -1)
    return total[:, 0], total[:, 1:] / np.maximum(total[:, :1], 1)


def _domains(batch: pa.RecordBatch) -> list[np.ndarray]:
    d = batch["domain"].to_numpy()
    return [d == 0, d == 1]


@dataclass
class CentroidGap:
    l2: float
    over_within: float
    cosine: float
    within: tuple[float, float]


def centroid_gap(rows: DataFrame) -> CentroidGap:
    """Distance of the domains' centroids, over the mean distance of rows from their own; cosine distance, 0 if a centroid is."""
    n, mean = _moments(rows)
    spread = summed(rows.select("domain", "x"), lambda b: np.array([np.linalg.norm(matrix(b["x"])[k] - mean[d], axis=1).sum() for d, k in enumerate(_domains(b))])) / np.maximum(n, 1)
    l2, norms = float(np.linalg.norm(mean[0] - mean[1])), float(np.prod(np.linalg.norm(mean, axis=1)))
    return CentroidGap(l2, l2 / max(float(spread.mean()), 1e-12), 1 - float(mean[0] @ mean[1]) / norms if norms else 0.0, (float(spread[0]), float(spread[1])))


def coral_distance(rows: DataFrame) -> float | None:
    """Squared distance of the domains' covariances over 4 d^2; None with fewer than two rows in one.

    Products are of rows less their domain's mean, which a pass before gives, so large means cost no digits.
    """
    if not _width(rows):
        return None
    n, mean = _moments(rows)
    if n.min() < 2:
        return None
    d = mean.shape[1]
    upper = np.triu_indices(d)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch["x"])
        centred = [x[k] - mean[domain] for domain, k in enumerate(_domains(batch))]
        return np.concatenate([(c.T @ c)[upper] for c in centred])

    cov = summed(rows.select("domain", "x"), products).reshape(2, -1) / (n[:, None] - 1)
    twice = np.where(upper[0] == upper[1], 1, 2)
    return float((twice * (cov[0] - cov[1]) ** 2).sum() / (4 * d * d))


# ---- all pairs, by meetings of blocks ----


def _blocks(rows: DataFrame, block: int) -> tuple[DataFrame, int]:
    n = rows.count()
    of = max(1, -(-n // block), min(24, n // 1024))  # smaller blocks where few would leave cores idle
    return rows.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(of)).cast("int")), of


def _pair_meetings(rows: DataFrame, block: int) -> GroupedData:
    """Each two blocks of ``rows``, and each block with itself, once."""
    dealt, of = _blocks(rows, block)
    tasks = min(of * (of + 1) // 2, 1 << 14)
    a = dealt.withColumn("_c", F.explode(F.sequence(F.col("_b"), F.lit(of - 1)))).select(*[F.col(c).alias(c) for c in rows.columns], F.col("_b").alias("_i"), F.col("_c").alias("_j")).repartition(tasks, "_i", "_j")
    b = dealt.withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_b")))).select(*rows.columns, F.col("_c").alias("_i"), F.col("_b").alias("_j")).repartition(tasks, "_i", "_j")
    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j"))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, from differences: exact zeros for equal rows."""
    out = np.empty((len(a), len(b)))
    for k in range(len(a)):
        out[k] = ((b - a[k]) ** 2).sum(axis=1)
    return out


class _Meeting:
    """Squared distances of all rows of one block and all of another, in tiles that a core's cache holds.

    A tile is one product of matrices, off by ``slack`` at most, by rounding; ``exact`` gives those of some pairs from differences.  Of a block
    with itself each pair comes twice, and each row with itself.
    """

    TILE = 128, 1024

    def __init__(self, key: tuple, a: pa.Table, b: pa.Table) -> None:
        self.same = key[0].as_py() == key[1].as_py()
        order = lambda t: t.take(np.argsort(t["domain"].to_numpy(), kind="stable"))
        a, b = order(a), order(b)
        self.a, self.b = matrix(a["x"]), matrix(b["x"])
        self.of_a, self.of_b = a["domain"].to_numpy(), b["domain"].to_numpy()
        centre = self.a.mean(axis=0)  # large means would cost digits
        x, y = self.a - centre, self.b - centre
        p, q = (x * x).sum(axis=1, keepdims=True), (y * y).sum(axis=1, keepdims=True)
        self.left, self.right = np.hstack([-2 * x, p, np.ones_like(p)]), np.hstack([y, np.ones_like(q), q]).T.copy()
        self.left_short, self.right_short = self.left.astype(np.float32), self.right.astype(np.float32)
        self.top = p.max() + q.max()
        self.raw = (self.a * self.a).sum(axis=1).max() + (self.b * self.b).sum(axis=1).max()

    def slack(self, kind: type) -> float:
        return 4 * np.finfo(kind).eps * np.sqrt(self.a.shape[1] + 8) * self.top + 8 * np.finfo(np.float64).eps * np.sqrt(self.top * self.raw)

    def tiles(self) -> Iterator[tuple[slice, slice]]:
        """Places of a tile's rows in both blocks; a tile has rows of one domain on each side."""
        for i in self._steps(self.of_a, self.TILE[0]):
            for j in self._steps(self.of_b, self.TILE[1]):
                yield i, j

    @staticmethod
    def _steps(domain: np.ndarray, most: int) -> list[slice]:
        ends = [0, int(np.searchsorted(domain, 1)), len(domain)]
        return [slice(k, min(k + most, to)) for start, to in zip(ends, ends[1:], strict=False) for k in range(start, to, most)]

    def squares(self, i: slice, j: slice) -> np.ndarray:
        return self.left[i] @ self.right[:, j]

    def short_squares(self, i: slice, j: slice) -> np.ndarray:
        return self.left_short[i] @ self.right_short[:, j]

    def exact(self, i: slice, j: slice, where: np.ndarray) -> np.ndarray:
        """Squared distances of those pairs of a tile, from differences: exact zeros for equal rows."""
        at, to = np.nonzero(where)
        out = np.empty(len(at))
        for k in range(0, len(at), 4096):
            part = slice(k, k + 4096)
            out[part] = ((self.b[j][to[part]] - self.a[i][at[part]]) ** 2).sum(axis=1)
        return out


#: Bits of a single-precision number that a bin of distances leaves open: bins are 2^-14 wide, of the number.
_OPEN = 9


def _bracket(rows: DataFrame, block: int) -> tuple[float, float]:
    """What the median of all positive squared distances lies between.  All pairs are counted, by the leading bits of a number of single precision."""

    def count(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        total, both = np.zeros(1 << 31 - _OPEN, dtype=np.int64), 1
        leading = lambda d: np.maximum(d.astype(np.float32, copy=False).view(np.int32) >> _OPEN, 0)
        if a.num_rows and b.num_rows:
            m = _Meeting(key, a, b)
            both += m.same
            # below these a number may be off by more than a bin
            short, full = (m.slack(kind) * 2 ** (23 - _OPEN) for kind in (np.float32, np.float64))
            for i, j in m.tiles():
                d, least = m.short_squares(i, j), short
                if np.count_nonzero(d < least) > d.size // 100:
                    d, least = m.squares(i, j), full
                heads = leading(d.ravel())
                if (bad := d < least).any():
                    # apart, as near 0 they would make the counts of a tile a long array
                    heads = heads[~bad.ravel()]
                    np.add.at(total, leading(m.exact(i, j, bad)), 1)
                if len(heads):
                    first = int(heads.min())
                    found = np.bincount(heads - first)
                    total[first : first + len(found)] += found
        heads = np.flatnonzero(total)
        return pa.table([pa.array(heads), pa.array(total[heads] // both)], names=["head", "n"])

    met = _pair_meetings(rows, block).applyInArrow(count, "head long, n long")
    infinite = int(np.array(np.inf, dtype=np.float32).view(np.int32)) >> _OPEN
    found = met.where(F.col("head").between(1, infinite)).groupBy("head").agg(F.sum("n").alias("n")).toPandas().sort_values("head")
    upto = found["n"].cumsum().to_numpy()
    if not len(upto):
        return 0.0, float(np.finfo(np.float32).tiny)
    heads = [int(found["head"].iloc[np.searchsorted(upto, rank, side="right")]) for rank in ((upto[-1] - 1) // 2, upto[-1] // 2)]
    # a bin more on both sides
    low, high = (float(np.array(h << _OPEN, dtype=np.int32).view(np.float32)) for h in (max(heads[0] - 1, 0), min(heads[1] + 2, infinite)))
    return low, high


#: Moments of a kernel's sums: with those of gamma d up to the second, a gamma that is off by 2e-4 of its value costs less than 2e-12 of a mean.
_MOMENTS = 3


def _added(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Values and how often each comes, from such pairs of arrays."""
    values, place = np.unique(np.concatenate([np.zeros(0), *[v for v, _ in counts]]), return_inverse=True)
    return values, np.bincount(place, np.concatenate([np.zeros(0), *[n for _, n in counts]]), len(values)).astype(np.int64)


def _moments_of_pairs(rows: DataFrame, low: float, high: float, gamma: float, block: int) -> tuple[np.ndarray, int, int, DataFrame]:
    """Of all pairs: sums of (gamma d)^k exp(-gamma d) by kind (both of domain 0, both of 1, one of each), how many d are positive, how many of these
    lie below ``low``, and (d, n) of the positive ones from there to ``high``.
    """
    kinds = 3 * _MOMENTS

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        sums, positive, below, inside = np.zeros((2, 2, _MOMENTS)), 0, 0, []
        same = False
        if a.num_rows and b.num_rows:
            m = _Meeting(key, a, b)
            same, slack = m.same, m.slack(np.float64)
            for i, j in m.tiles():
                d = m.squares(i, j)
                near = (d >= low - slack) & (d <= high + slack) | (d <= slack) if gamma * slack < 1e-11 else np.ones(d.shape, dtype=bool)
                zeros = 0
                if near.any():
                    d[near] = found = m.exact(i, j, near)
                    inside.append(np.unique(found[(found > 0) & (found >= low) & (found <= high)], return_counts=True))
                    if sum(len(v) for v, _ in inside[1:]) > 1 << 18:
                        inside = [_added(inside)]  # many pairs may be equally far
                    zeros = np.count_nonzero(found == 0)
                positive += np.count_nonzero(d >= 0) - zeros
                below += np.count_nonzero(d < low) - (zeros if low > 0 else 0)
                d *= gamma
                w = np.exp(-d)
                of = sums[m.of_a[i.start], m.of_b[j.start]]
                of[0] += w.sum()
                for k in range(1, _MOMENTS):
                    w *= d
                    of[k] += w.sum()
            if same:
                for x in (0, 1):
                    sums[x, x, 0] -= (m.of_a == x).sum()  # rows with themselves
        values, n = _added(inside)
        flat = np.stack([sums[0, 0], sums[1, 1], sums[0, 1] + sums[1, 0]]).ravel() / (1 + same)
        kind = np.concatenate([np.arange(kinds + 2), np.full(len(values), -1)])
        return pa.table([pa.array(kind), pa.array(np.concatenate([flat, [0, 0], values])), pa.array(np.concatenate([np.zeros(kinds, dtype=np.int64), [positive, below], n]) // (1 + same))], names=["kind", "v", "n"])

    met = cut(_pair_meetings(rows, block).applyInArrow(meet, "kind long, v double, n long"), "pairs")
    total = met.where("kind >= 0").groupBy("kind").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas().set_index("kind")
    inside = met.where("kind < 0").select(F.col("v").alias("d"), "n")
    return total["v"].reindex(range(kinds)).to_numpy().reshape(3, _MOMENTS), int(total["n"][kinds]), int(total["n"][kinds + 1]), inside


def _ranked(inside: DataFrame, low: float, high: float, rank: int) -> float | None:
    """The d at a place, from 0, among (d, n) from ``low`` to ``high``; None if they don't reach it.  Only rows of one cell of 4,096 are sorted."""
    cell = F.floor((F.col("d") - F.lit(low)) / F.lit((high - low) / 4096))
    counts = inside.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n")).toPandas().sort_values("cell")
    upto = counts["n"].cumsum().to_numpy()
    if not len(upto) or not 0 <= rank < upto[-1]:
        return None
    at = int(np.searchsorted(upto, rank, side="right"))
    rest = rank - (int(upto[at - 1]) if at else 0)
    placed = running_totals(inside.where(cell == int(counts["cell"].iloc[at])), [F.col("d")], "n", "before")
    return placed.where((F.col("before") <= rest) & (F.col("before") + F.col("n") > rest)).first()["d"]


def _median_and_moments(rows: DataFrame, block: int) -> tuple[float, float, np.ndarray]:
    """The exact median of all positive squared distances (1 if there is none), a gamma near its own, and the sums of pairs for that gamma.

    All pairs are worked out twice: once to bound the median by two near numbers, once to count those below and keep those between, from differences.
    """
    low, high = _bracket(rows, block)
    while True:
        gamma = 1 / max(low + high, 1e-12)
        sums, positive, below, inside = _moments_of_pairs(rows, low, high, gamma, block)
        if not positive:
            return 1.0, gamma, sums
        middle = [_ranked(inside, low, high, k - below) for k in sorted({(positive - 1) // 2, positive // 2})]
        if None not in middle:
            return (middle[0] + middle[-1]) / 2, gamma, sums
        low, high = low / 4, high * 4  # rounding was worse than its bound


def median_square(rows: DataFrame, block: int = 16384) -> float:
    """The exact median of all positive squared distances of two rows; 1 if there is none."""
    return _median_and_moments(rows.select("id", "domain", "x"), block)[0]


def kernel_distance(rows: DataFrame, block: int = 16384) -> tuple[float, float] | None:
    """(mmd2, gamma): the domains' distance under exp(-gamma d^2), gamma from the median; means take each row with itself too.

    None with fewer than two rows in a domain.
    """
    n = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if min(n.get(0, 0), n.get(1, 0)) < 2:
        return None
    rows = cut(rows.select("id", "domain", "x"), "vectors")
    median, near, sums = _median_and_moments(rows, block)
    gamma = 1 / max(2 * median, 1e-12)
    off = 1 - gamma / near
    if abs(off) > 2e-4:
        sums, off = _moments_of_pairs(rows, np.inf, np.inf, gamma, block)[0], 0.0
    # exp(-gamma d) as a series in how far gamma is off
    s = sums @ np.array([off**k / math.factorial(k) for k in range(_MOMENTS)])
    return float((2 * s[0] + n[0]) / n[0] ** 2 + (2 * s[1] + n[1]) / n[1] ** 2 - 2 * s[2] / (n[0] * n[1])), gamma


# ---- nearest rows of the other domain ----


def nearest(rows: DataFrame, by: Sequence[str] = (), pivots: int = 32, block: int = 4096) -> DataFrame:
    """(id, domain, by..., nearest, distance, compared): for each row the nearest one of the other domain, the smaller id among equals.

    ``by``: only rows that are equal in these meet.  Each row belongs to the nearest of some pivots, and the rows of a pivot form rings of
    at most about ``block`` rows by their distance from it.  The triangle inequality bounds a row's distance from all of a ring from both
    sides, so it meets only rings that may hold its nearest row.  ``compared``: how many rows it was compared with.
    """
    by = list(by)
    rows = cut(rows.where(F.col("x").isNotNull()).select("id", "domain", *by, "x"), "vectors")
    chosen = rows.orderBy(hash_order("pivot", "id", "domain")).limit(pivots).select("x").collect()
    if not chosen:
        return rows.select("id", "domain", *by, F.lit(None).cast("long").alias("nearest"), F.lit(None).cast("double").alias("distance"), F.lit(0).cast("long").alias("compared"))
    centres = np.array([r["x"] for r in chosen], dtype=np.float64)

    def from_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                d = np.sqrt(_squares(matrix(batch["x"]), centres))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(d), pa.list_(pa.float64())), pa.array(d.argmin(axis=1)), pa.array(d.min(axis=1))], names=[*batch.schema.names, "far", "cell", "own"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = cut(rows.mapInArrow(from_pivots, f"{kinds}, far array<double>, cell long, own double"), "placed")
    ringed = cut(number_in_groups(placed.drop("far"), [*by, "domain", "cell"], [F.col("own"), F.col("id")], "k", "n").withColumn("ring", F.expr(f"k div {block}")).drop("k", "n"), "ringed")
    rings = ringed.groupBy(*by, F.col("domain").alias("other"), "cell", "ring").agg(F.min("own").alias("lo"), F.max("own").alias("hi"))
    slack = 1 + 1e-9  # of rounding
    q = placed.select("id", "domain", *by, "x", (1 - F.col("domain")).alias("other"), "far")
    met = q.join(rings, [*by, "other"]).withColumn("d", F.get("far", F.col("cell").cast("int"))).drop("far")
    bounds = met.withColumns({"least": F.greatest(F.col("d") - F.col("hi"), F.col("lo") - F.col("d"), F.lit(0.0)), "most": F.col("d") + F.col("lo")})
    best = bounds.groupBy("id", "domain", *by).agg(F.min("most").alias("best"))
    wanted = bounds.join(best, ["id", "domain", *by]).where(F.col("least") <= F.col("best") * slack + 1e-12)
    of = max(1, -(-rows.count() // block))
    place = [*by, "other", "cell", "ring", "_q"]
    asked = wanted.withColumn("_q", F.pmod(F.xxhash64("id"), F.lit(of))).select(*place, "id", "domain", "x")
    there = ringed.withColumn("other", F.col("domain")).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))).select(*[F.col(c).alias(c) for c in place], F.col("id").alias("n"), F.col("x").alias("y"))

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            at, d = np.zeros(a.num_rows, dtype=np.int64), np.full(a.num_rows, np.inf)
            a, ids = a.slice(0, 0), np.zeros(1, dtype=np.int64)
            at, d = at[:0], d[:0]
        else:
            b = b.take(np.argsort(b["n"].to_numpy(), kind="stable"))
            squares, ids = _squares(matrix(a["x"]), matrix(b["y"])), b["n"].to_numpy()
            at = squares.argmin(axis=1)
            d = np.sqrt(squares[np.arange(len(at)), at])
        columns = [a["id"], a["domain"], *(a[c] for c in by), pa.array(ids[at]), pa.array(d), pa.array(np.full(len(at), b.num_rows))]
        return pa.table(columns, names=["id", "domain", *by, "nearest", "distance", "compared"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("x").schema.fields)
    found = asked.groupBy(*place).cogroup(there.groupBy(*place)).applyInArrow(meet, f"{kinds}, nearest long, distance double, compared long")
    return found.groupBy("id", "domain", *by).agg(F.min_by("nearest", F.struct("distance", "nearest")).alias("nearest"), F.min("distance").alias("distance"), F.sum("compared").alias("compared"))


# ---- a separator ----


def auc(rows: DataFrame, score: str, label: str) -> float | None:
    """The chance that a row of label 1 scores above one of label 0, ties counting half; None without one of either.

    Rows are counted by score, and the counts summed up by sorted ranges of scores.
    """
    counts = rows.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    before = running_totals(counts, [F.col(score)], "neg", "less")
    r = before.agg(F.sum(F.col("pos") * (2 * F.col("less") + F.col("neg"))).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return r["wins"] / (2 * r["p"] * r["n"]) if r["p"] and r["n"] else None


@dataclass
class Separator:
    """Weights of standardised features, the last one the constant; of the model over all rows."""

    weights: np.ndarray
    predictions: DataFrame
    folds: int


def separate(rows: DataFrame, folds: int = 5, seed: str = "fold", ridge: float = 1.0, penalise_constant: bool = True, scaled: bool = True, steps: int = 12) -> Separator:
    """A balanced logistic separator of the domains, and (id, domain, fold, p) with each row judged by a model that hasn't seen it.

    Rows of a domain are dealt to folds by turns in an order of hashes.  A model standardises by its own rows, if ``scaled``; each domain's rows weigh half of all.  It
    minimises ridge / 2 times the squared weights plus the weighted logistic loss, by Newton's method: one pass a step gives the
    gradients and Hessians of the models of all folds, and of all rows, as one array of fixed length.
    """
    dealt = number_in_groups(rows.select("id", "domain", "x"), ["domain"], [hash_order(seed, "id"), F.col("id")], "k", "n")
    dealt = cut(dealt.select("id", "domain", "x", F.pmod("k", F.lit(folds)).alias("fold")), "folds")
    d = _width(dealt)
    models = folds + 1  # the last one is of all rows

    def of_fold(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return matrix(batch["x"]), batch["domain"].to_numpy(), batch["fold"].to_numpy()

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        x, y, f = of_fold(batch)
        return np.concatenate([np.concatenate([[(~y[k].astype(bool)).sum(), y[k].sum()], x[k].sum(axis=0)]) for k in (f != m for m in range(models))])

    total = summed(dealt, counts).reshape(models, -1)
    n, mean = total[:, :2], total[:, 2:] / total[:, :2].sum(axis=1, keepdims=True)
    squares = summed(dealt, lambda b: np.concatenate([((of_fold(b)[0][of_fold(b)[2] != m] - mean[m]) ** 2).sum(axis=0) for m in range(models)])).reshape(models, -1)
    spread = np.sqrt(squares / n.sum(axis=1, keepdims=True))
    scale = np.where(spread > 1e-12, spread, 1.0)
    if not scaled:
        mean, scale = np.zeros_like(mean), np.ones_like(scale)
    balance = n.sum(axis=1, keepdims=True) / (2 * n)
    design = lambda x, m: np.concatenate([(x - mean[m]) / scale[m], np.ones((len(x), 1))], axis=1)
    weights, penalty = np.zeros((models, d + 1)), np.full(d + 1, ridge)
    penalty[d] = ridge if penalise_constant else 0.0
    for _ in range(steps):

        def derivatives(batch: pa.RecordBatch, weights: np.ndarray = weights) -> np.ndarray:
            x, y, f = of_fold(batch)
            out = []
            for m in range(models):
                k = f != m
                z, t = design(x[k], m), y[k]
                p = 1 / (1 + np.exp(-np.clip(z @ weights[m], -500, 500)))
                c = balance[m][t]
                out += [z.T @ (c * (p - t)), ((z * (c * p * (1 - p))[:, None]).T @ z).ravel()]
            return np.concatenate(out)

        found = summed(dealt, derivatives).reshape(models, -1)
        moves = [np.linalg.solve(h.reshape(d + 1, d + 1) + np.diag(penalty + 1e-12), g + penalty * w) for g, h, w in zip(found[:, : d + 1], found[:, d + 1 :], weights, strict=True)]
        weights = weights - np.array(moves)
        if max(np.abs(m).max() for m in moves) < 1e-10:
            break

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, _, f = of_fold(batch)
                p = np.empty(len(f))
                for m in np.unique(f):
                    k = f == m
                    p[k] = 1 / (1 + np.exp(-np.clip(design(x[k], m) @ weights[m], -500, 500)))
                yield pa.RecordBatch.from_arrays([batch["id"], batch["domain"], batch["fold"], pa.array(p)], names=["id", "domain", "fold", "p"])

    kind = dealt.schema["id"].dataType.simpleString()
    return Separator(weights[folds], dealt.mapInArrow(judge, f"id {kind}, domain long, fold long, p double"), folds)
