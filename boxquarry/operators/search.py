"""Searches over one bounded list: the best combination, an annealed subset, and a mix of patterns by integer programming.

The lists are small by nature and their sizes are checked, with an error beyond; what grows is the number of combinations, restarts or
patterns, and these are what Spark deals out or counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- all combinations ----


def combinations_at(ranks: np.ndarray, n: int, k: int) -> np.ndarray:
    """The combinations of k out of n places with these numbers, as listed in the order of their places."""
    left = math.comb(n, k) - 1 - ranks.astype(np.int64)
    out = np.empty((len(ranks), k), dtype=np.int64)
    for j in range(k, 0, -1):
        sizes = np.array([math.comb(c, j) for c in range(n + 1)], dtype=np.int64)
        c = np.searchsorted(sizes, left, side="right") - 1
        left = left - sizes[c]
        out[:, k - j] = n - 1 - c
    return out


@dataclass(frozen=True)
class Balance:
    """What counts of classes are asked for; None or 0: nothing."""

    min_per_class: int = 0
    max_spread: int | None = None
    max_ratio: float | None = None

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """One row of seven numbers for each row of counts; the smaller row, compared from the left, is the better balance.

        Lacking boxes, spread and ratio beyond their limits, spread, distance from the mean, least and total count (more is better).
        """
        least, most = counts.min(axis=1), counts.max(axis=1)
        spread = most - least
        ratio = np.where(least > 0, np.round(most / np.maximum(least, 1), 6), 1_000_000.0)
        zero = np.zeros(len(counts))
        return np.stack(
            [
                np.maximum(self.min_per_class - counts, 0).sum(axis=1),
                np.maximum(spread - self.max_spread, 0) if self.max_spread is not None else zero,
                np.maximum(ratio - self.max_ratio, 0) if self.max_ratio is not None else zero,
                spread,
                np.round(np.abs(counts - counts.mean(axis=1, keepdims=True)).sum(axis=1), 6),
                -least,
                -counts.sum(axis=1),
            ],
            axis=1,
        ).astype(np.float64)

    def passes(self, counts: np.ndarray) -> np.ndarray:
        least, most = counts.min(axis=1), counts.max(axis=1)
        ok = least >= self.min_per_class if self.min_per_class > 0 else np.ones(len(counts), dtype=bool)
        if self.max_spread is not None:
            ok &= most - least <= self.max_spread
        if self.max_ratio is not None:
            ok &= (least > 0) & (np.round(most / np.maximum(least, 1), 6) <= self.max_ratio)
        return ok


def best_combination(pool: DataFrame, item: str, counts: str, size: int, balance: Balance, most: int = 20_000_000) -> DataFrame:
    """(item, status, and the seven numbers of the score) of the best ``size`` items: the first best combination that keeps all limits, else the first best.

    ``pool``: one row an item, in the order of items, with an array of the counts of all classes.  All combinations are numbered, dealt out by ranges of
    numbers, and scored in blocks; more than ``most`` raise.  A pool of fewer items raises; status is "passed" or "failed_constraints".
    """
    spark = pool.sparkSession
    at_most = size + 1
    while math.comb(at_most, size) <= most:
        at_most += 1
    rows = pool.select(item, counts).orderBy(item).limit(at_most).collect()
    n = len(rows)
    if n < size:
        raise ValueError(f"{size} of {n} items are asked for")
    if n == at_most:
        raise ValueError(f"more than {most} combinations")
    vectors = np.array([r[1] for r in rows], dtype=np.int64).reshape(n, -1)
    total = math.comb(n, size)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = batch["id"].to_numpy()
            if not len(ranks):
                continue
            sums = vectors[combinations_at(ranks, n, size)].sum(axis=1)
            scores, ok = balance.scores(sums), balance.passes(sums)
            for late, some in ((0, np.flatnonzero(ok)), (1, np.arange(len(ranks)))):
                if len(some):
                    first = some[np.lexsort((ranks[some], *scores[some].T[::-1]))[0]]
                    yield pa.RecordBatch.from_arrays([pa.array([late]), pa.array([list(scores[first])], pa.list_(pa.float64())), pa.array([int(ranks[first])])], names=["late", "score", "rank"])

    best = spark.range(0, total, 1, max(1, min(total // 20_000, 4096))).mapInArrow(search, "late long, score array<double>, rank long").orderBy("late", "score", "rank").limit(1).collect()[0]
    status = "failed_constraints" if best["late"] else "passed"
    chosen = combinations_at(np.array([best["rank"]]), n, size)[0]
    names = ["deficit", "spread_over", "ratio_over", "spread", "mean_distance", "least", "total"]
    kind = pool.schema[item].dataType.simpleString()
    return spark.createDataFrame([(rows[k][0], status, *best["score"]) for k in chosen], f"{item} {kind}, status string, " + ", ".join(f"{c} double" for c in names))


# ---- annealing ----

#: Whole numbers stand for features in steps of a millionth, so sums are exact in any order.
UNIT = 1_000_000


@dataclass
class Goal:
    """What a selected subset should look like.  Limits are of the distance from the real means; 0, None or empty: nothing is asked.

    ``real``: means by metric of images, of boxes, and of each class's boxes (classes by metrics).
    """

    image: np.ndarray
    image_limits: np.ndarray
    box: np.ndarray
    box_limits: np.ndarray
    class_box: np.ndarray
    class_limits: np.ndarray
    class_weights: np.ndarray
    min_per_class: int = 0
    max_class_ratio: float = 0.0
    max_class_spread: int = -1
    root_min: dict[int, int] = field(default_factory=dict)
    root_max: dict[int, int] = field(default_factory=dict)
    min_profiles: int = 0
    min_conditions: int = 0
    min_class_profiles: int = 0
    min_class_conditions: int = 0
    min_ranges: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Candidates:
    """One row an item: metrics in units, sums and counts of boxes by class, its root, profile and conditions, and values whose range matters."""

    names: list
    image: np.ndarray  # items x image metrics
    boxes: np.ndarray  # items x classes x box metrics, sums in units
    counts: np.ndarray  # items x classes
    root: np.ndarray
    profile: np.ndarray
    conditions: np.ndarray  # items x conditions, 0 or 1
    ranged: np.ndarray  # items x fields

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.image, self.boxes, self.counts, self.root, self.profile, self.conditions, self.ranged))


class Selection:
    """A subset and all sums that its score needs; a swap changes the sums by the two items' rows."""

    def __init__(self, c: Candidates, goal: Goal, chosen: Sequence[int]):
        self.c, self.goal, self.chosen = c, goal, list(chosen)
        k, n = np.array(self.chosen), len(c.names)
        self.inside = np.zeros(n, dtype=bool)
        self.inside[k] = True
        self.image, self.boxes, self.counts = c.image[k].sum(axis=0), c.boxes[k].sum(axis=0), c.counts[k].sum(axis=0)
        self.roots, self.profiles = np.bincount(c.root[k], minlength=c.root.max() + 1), np.bincount(c.profile[k], minlength=c.profile.max() + 1)
        self.conditions = c.conditions[k].sum(axis=0)
        has = c.counts[k] > 0
        self.class_profiles = np.zeros((c.counts.shape[1], c.profile.max() + 1), dtype=np.int64)
        for row, p in zip(has, c.profile[k], strict=True):
            self.class_profiles[row, p] += 1
        self.class_conditions = has.astype(np.int64).T @ c.conditions[k]

    def _move(self, item: int, sign: int) -> None:
        c = self.c
        self.image = self.image + sign * c.image[item]
        self.boxes = self.boxes + sign * c.boxes[item]
        self.counts = self.counts + sign * c.counts[item]
        self.roots[c.root[item]] += sign
        self.profiles[c.profile[item]] += sign
        self.conditions = self.conditions + sign * c.conditions[item]
        has = c.counts[item] > 0
        self.class_profiles[has, c.profile[item]] += sign
        self.class_conditions[has] += sign * c.conditions[item]
        self.inside[item] = sign > 0

    def swap(self, place: int, incoming: int) -> int:
        """Puts ``incoming`` in the place of a chosen item, and returns that item."""
        outgoing = self.chosen[place]
        self._move(outgoing, -1)
        self._move(incoming, 1)
        self.chosen[place] = incoming
        return outgoing

    def score(self) -> tuple[float, int]:
        """The penalties' sum, 0 at best, and how many limits are broken."""
        g, broken, score = self.goal, 0, 0.0

        def far(delta: np.ndarray, limits: np.ndarray, weight: np.ndarray | float, fine: float) -> None:
            nonlocal broken, score
            over = np.abs(delta) > limits
            score += float((weight * (np.abs(delta) / np.maximum(limits, 1e-9)) ** 2 + fine * over).sum())
            broken += int(over.sum())

        def lack(missing: np.ndarray | float, fine: float) -> None:
            nonlocal broken, score
            missing = np.maximum(missing, 0)
            score += float(fine * np.sum(missing))
            broken += int(np.count_nonzero(missing))

        boxes = max(int(self.counts.sum()), 1)
        far(self.image / UNIT / len(self.chosen) - g.image, g.image_limits, 2.0, 80.0)
        far(self.boxes.sum(axis=0) / UNIT / boxes - g.box, g.box_limits, 3.0, 100.0)
        least, most = int(self.counts.min()), int(self.counts.max())
        lack(g.min_per_class - least, 1000.0)
        if g.max_class_spread >= 0:
            lack(most - least - g.max_class_spread, 500.0)
        if g.max_class_ratio > 0:
            lack((most / least if least else 1e6) - g.max_class_ratio, 500.0)
        for root, n in g.root_min.items():
            lack(n - self.roots[root], 600.0)
        for root, n in g.root_max.items():
            lack(self.roots[root] - n, 600.0)
        lack(g.min_profiles - np.count_nonzero(self.profiles), 750.0)
        lack(g.min_conditions - np.count_nonzero(self.conditions), 750.0)
        lack(g.min_class_profiles - np.count_nonzero(self.class_profiles, axis=1), 250.0)
        lack(g.min_class_conditions - np.count_nonzero(self.class_conditions, axis=1), 250.0)
        if len(g.min_ranges):
            values = self.c.ranged[self.chosen] / UNIT
            missing = np.maximum(g.min_ranges - np.ptp(values, axis=0), 0)
            lack(missing, 300.0)
            score += float((20.0 * (missing / np.maximum(g.min_ranges, 1e-9)) ** 2).sum())
        there = self.counts > 0
        score += 10_000.0 * int((~there).sum())
        broken += int((~there).sum())
        means = self.boxes[there] / UNIT / self.counts[there, None]
        far(means - g.class_box[there], np.broadcast_to(g.class_limits, means.shape), g.class_weights, 0.0)
        over = np.abs(means - g.class_box[there]) > g.class_limits
        score += float((50.0 * g.class_weights * over).sum())
        return score, broken


def anneal(c: Candidates, goal: Goal, size: int, seed: int, restart: int, steps: int) -> tuple[float, int, list[int]]:
    """The best subset on one walk: swaps that score less are taken, others with a chance that falls with the temperature."""
    draw = np.random.default_rng([seed, restart])
    now = Selection(c, goal, draw.choice(len(c.names), size, replace=False).tolist())
    current = now.score()
    best = (*current, sorted(now.chosen))
    temperature = 6.0
    for _ in range(steps):
        place, incoming, luck = int(draw.integers(size)), int(draw.integers(len(c.names))), draw.random()
        if now.inside[incoming]:
            continue
        outgoing = now.swap(place, incoming)
        found = now.score()
        if found[0] < current[0] or luck < math.exp((current[0] - found[0]) / max(0.5, temperature)):
            current = found
            if found[0] < best[0]:
                best = (*found, sorted(now.chosen))
        else:
            now.swap(place, outgoing)
        temperature *= 0.997
    return best


def annealed_subset(spark, c: Candidates, goal: Goal, size: int, restarts: int = 16, steps: int = 400, seed: int = 0, most_bytes: int = 64 << 20) -> tuple[float, int, list]:
    """(score, broken limits, items) of the best of all restarts, each a row that some task walks; the same however they are dealt.

    The candidates go to all tasks, so more than ``most_bytes`` of them raise, as does a ``size`` beyond their number.
    """
    if c.nbytes() > most_bytes:
        raise ValueError(f"{c.nbytes()} bytes of candidates, of {most_bytes}")
    if not 0 < size <= len(c.names):
        raise ValueError(f"{size} of {len(c.names)} candidates are asked for")
    shared = spark.sparkContext.broadcast((c, goal))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for restart in batch["id"].to_pylist():
                score, broken, chosen = anneal(*shared.value, size, seed, restart, steps)
                yield pa.RecordBatch.from_arrays([pa.array([score]), pa.array([restart]), pa.array([broken]), pa.array([chosen], pa.list_(pa.int64()))], names=["score", "restart", "broken", "chosen"])

    walks = spark.range(0, restarts, 1, restarts).mapInArrow(walk, "score double, restart long, broken long, chosen array<long>")
    best = walks.orderBy("score", "restart").limit(1).collect()[0]
    return best["score"], best["broken"], [c.names[k] for k in best["chosen"]]


# ---- integer programme ----


@dataclass(frozen=True)
class Mix:
    """How often each pattern is taken, and what is missing of the target by class."""

    times: list[int]
    missing: list[int]


def _bound(values: np.ndarray, uppers: np.ndarray, rows: int) -> float:
    """The largest sum of ``rows`` values, each as often as allowed; -inf if there are fewer."""
    upto = np.cumsum(uppers)
    if rows > (upto[-1] if len(upto) else 0):
        return -np.inf
    take = np.clip(rows - (upto - uppers), 0, uppers)
    return float(values @ take)


def _greedy_mix(patterns: np.ndarray, uppers: np.ndarray, target: np.ndarray, rows: int) -> np.ndarray | None:
    """A first mix: row by row a pattern of about the average size that is still needed, of the classes that lack most."""
    times, room, sizes = np.zeros(len(uppers), dtype=np.int64), target.copy(), patterns.sum(axis=1)
    for left in range(rows, 0, -1):
        able = (times < uppers) & (patterns <= room).all(axis=1)
        rest = room.sum() - sizes
        able &= rest >= (left - 1) * sizes.min(initial=0)
        if not able.any():
            return None
        wanted = -(-int(room.sum()) // left)
        fit = np.where(able, -np.abs(sizes - wanted) * 1e6 + patterns @ room, -np.inf)
        k = int(fit.argmax())
        times[k] += 1
        room = room - patterns[k]
    return times


def mix_patterns(patterns: np.ndarray, uppers: Sequence[int], target: Sequence[int], rows: int, most_nodes: int = 200_000) -> Mix | None:
    """Exactly ``rows`` rows whose patterns (patterns by classes) stay within ``target``: the least boxes missing, then the least sum of shares missing.

    None if no such rows exist.  Branch and bound from a greedy mix on: pattern by pattern, the largest first and more of it first, as small ones fill what is left; a
    bound prices classes by multipliers that a subgradient search finds for the whole problem, after which the rows that are left are the
    dearest ones.  More than ``most_nodes`` nodes raise.
    """
    patterns, target = np.asarray(patterns, dtype=np.int64).reshape(len(uppers), len(target)), np.asarray(target, dtype=np.int64)
    uppers = np.minimum(np.asarray(uppers, dtype=np.int64), rows)
    # each box is worth 1, and its class's share a little more: so little that no sum of shares is worth a box
    share = 1 / np.maximum(target, 1)
    worth = patterns.sum(axis=1) + patterns @ share / (share @ target + 1) if len(target) else np.zeros(len(uppers))
    price = np.zeros(len(target))
    best_price, least = price, np.inf
    for step in range(300):
        value = worth - patterns @ price
        order = np.argsort(-value, kind="stable")
        take = np.zeros(len(uppers), dtype=np.int64)
        take[order] = np.clip(rows - (np.cumsum(uppers[order]) - uppers[order]), 0, uppers[order])
        bound = float(value @ take) + float(price @ target)
        if bound < least:
            least, best_price = bound, price
        over = take @ patterns - target
        if not over.any():
            break
        price = np.maximum(price + over / (np.linalg.norm(over) * (1 + step) ** 0.5), 0)
    order = np.lexsort((np.arange(len(uppers)), -worth))
    patterns, uppers, worth = patterns[order], uppers[order], worth[order]
    value, sizes = worth - patterns @ best_price, patterns.sum(axis=1)
    by_value = np.argsort(-value, kind="stable")
    chosen, nodes = _greedy_mix(patterns, uppers, target, rows), 0
    best = -np.inf if chosen is None else float(chosen @ worth)
    # no mix is worth more than all of the target
    least = min(least, float(target.sum() + share @ target / (share @ target + 1))) if len(target) else least
    times = np.zeros(len(uppers), dtype=np.int64)
    # (pattern, rows left, room left, worth so far, how often the pattern before is taken)
    stack: list[tuple[int, int, np.ndarray, float, int]] = [(0, rows, target, 0.0, -1)]
    while stack and best < least - 1e-9:
        k, left, room, got, before = stack.pop()
        nodes += 1
        if nodes > most_nodes:
            raise ValueError(f"more than {most_nodes} nodes")
        if before >= 0:
            times[k - 1] = before
        times[k:] = 0
        if not left:
            if got > best + 1e-9:
                best, chosen = got, times.copy()
            continue
        able = np.zeros(len(uppers), dtype=np.int64)
        able[k:] = np.minimum(uppers[k:], np.where(patterns[k:] > 0, room // np.maximum(patterns[k:], 1), left).min(axis=1, initial=left))
        ready = np.flatnonzero(able)
        if not len(ready) or room.sum() < left * sizes[ready].min():
            continue
        if got + _bound(value[by_value], able[by_value], left) + best_price @ room <= best + 1e-9:
            continue
        # patterns that can't be taken at all need no node
        k = int(ready[0])
        for t in range(int(able[k]) + 1):
            stack.append((k + 1, left - t, room - t * patterns[k], got + t * worth[k], t))
    if chosen is None:
        return None
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return Mix(chosen[back].tolist(), (target - chosen @ patterns).tolist())


def patterns_of(rows: DataFrame, item: str, classes: Sequence[int], most: Sequence[int]) -> DataFrame:
    """(item, vector): the counts of ``classes`` in each item; items with other classes, or with more than ``most`` of one, go.

    ``rows``: one row (item, class_id, n) for each class of an item.
    """
    place = F.create_map(*[F.lit(x).cast("long") for k, c in enumerate(classes) for x in (c, k)])
    limit = F.create_map(*[F.lit(x).cast("long") for pair in zip(classes, most, strict=True) for x in pair])
    fits = F.bool_and(F.col("n") <= F.coalesce(limit[F.col("class_id")], F.lit(0)))
    known = F.filter(F.collect_list(F.struct(place[F.col("class_id")].alias("k"), "n")), lambda x: x["k"].isNotNull())
    found = rows.groupBy(item).agg(F.map_from_entries(known).alias("m"), fits.alias("ok")).where("ok")
    vector = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(len(classes) - 1).cast("long")), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)).cast("long"))
    return found.select(item, vector.alias("vector"))
