"""Quality scores by Bradley-Terry pairwise ranking: logistic loss on feature differences of preference pairs of all labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxquarry.llm.arrow_batches import byte_slices
from boxquarry.llm.storage import cut, discard
from boxquarry.llm.text_hashing import SPACE_WORDS, utf8_buffers, word_hashes
from boxquarry.operators.selection import number_rows
from boxquarry.operators.statistics import quantiles

THRESHOLD = 0.7
RIDGE, STEPS = 3e-3, 12

#: Classes of bytes: small letters, capitals, digits, spaces, line ends, other control bytes, beyond ASCII, and each sign.
_CLASS = np.full(256, 5, dtype=np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x20], _CLASS[[0x0A, 0x0D]], _CLASS[0x80:] = 0, 1, 2, 3, 4, 6
_SIGNS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_CLASS[_SIGNS] = 7 + np.arange(len(_SIGNS))
_CLASSES = 7 + len(_SIGNS)
FEATURES = 2 * _CLASSES + 8


def text_features(column: pa.Array) -> np.ndarray:
    """FEATURES numbers for each text: shares of byte classes and their roots, and shapes of words and lines."""
    data, bounds = utf8_buffers(column)
    n, sizes = len(bounds) - 1, np.maximum(np.diff(bounds), 1)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    share = np.bincount(owner * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES) / sizes[:, None]
    words, at = word_hashes(column, SPACE_WORDS)
    more = np.zeros((n, 8))
    for k, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        own = np.sort(words[lo:hi])
        if not len(own):
            continue
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        repeats = np.diff(starts, append=len(own))
        pairs = np.sort(words[lo : hi - 1] * np.uint64(0x9E3779B97F4A7C15) + words[lo + 1 : hi])
        distinct_pairs = 1 + np.count_nonzero(pairs[1:] != pairs[:-1]) if len(pairs) else 0
        more[k, :5] = len(starts) / len(own), len(starts) / np.sqrt(len(own)), repeats.max() / len(own), distinct_pairs / max(len(pairs), 1), sizes[k] / len(own)
        more[k, 5] = np.sqrt(np.count_nonzero(repeats == 1) / len(own))
    more[:, 6] = np.log1p(np.diff(at))
    more[:, 7] = np.log1p(share[:, 4] * sizes) / np.log1p(sizes)
    return np.concatenate([share, np.sqrt(share), more], axis=1)


@dataclass
class Ranker:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float = 0.0
    unit: float = 1.0

    def raw(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.centre) / self.scale, -8, 8) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        """0 to 1; the chosen quantile of scores is at THRESHOLD."""
        above = (self.raw(features) - self.cut) / self.unit
        score = 1 / (1 + np.exp(-np.clip(above + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))
        return np.where(above >= 0, np.maximum(score, THRESHOLD), score)


def _standard(features: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((features - centre) / scale, -8, 8)


def _newton(w: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, pairs: float, ridge: float) -> np.ndarray:
    """One step down the mean logistic loss, from the sums of its derivatives over all pairs."""
    return w - np.linalg.solve(hessian / pairs + ridge * np.eye(len(w)), gradient / pairs + ridge * w)


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss, summed over each pair of a row of ``good`` and one of ``bad``, without the pairs' own features."""
    p = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - (bad @ w)[None, :], -30, 30)))
    q = p * (1 - p)
    cross = good.T @ (q @ bad)
    hessian = (good * q.sum(axis=1)[:, None]).T @ good + (bad * q.sum(axis=0)[:, None]).T @ bad - cross - cross.T
    return p.sum(axis=0) @ bad - p.sum(axis=1) @ good, hessian


def fit_ranker(features: np.ndarray, labels: np.ndarray, pairs: int | None = None, ridge: float = RIDGE, seed: int = 11) -> Ranker:
    """From all pairs of a better and a worse document, or from ``pairs`` of them drawn at random; for rows that fit into memory.

    The cut is the score quantile at the share of label 0.  With one label only, every text gets THRESHOLD.
    """
    centre, scale = features.mean(axis=0), features.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    model = Ranker(centre, scale, np.zeros(features.shape[1]))
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return model
    x = _standard(features, centre, scale)
    w = model.weights
    if pairs is not None:
        draw = np.random.default_rng(seed)
        d = x[draw.choice(good, pairs)] - x[draw.choice(bad, pairs)]
    for _ in range(STEPS):  # Newton's method
        if pairs is None:
            gradient, hessian = pair_sums(x[good], x[bad], w)
        else:
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            gradient, hessian = -(d.T @ p), (d * (p * (1 - p))[:, None]).T @ d
        w = _newton(w, gradient, hessian, len(good) * len(bad) if pairs is None else pairs, ridge)
    model.weights = w
    raw = x @ w
    model.cut = float(np.quantile(raw, len(bad) / len(labels)))
    model.unit = float(max(raw.std(), 1e-9))
    return model


def _totals(rows: DataFrame, sums: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of an array of fixed length over all batches of rows: one array a task, added up by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, len(batch), 64):
                own = sums(batch.slice(at, 64))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    found = rows.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    return found.toPandas().sort_values("k")["v"].to_numpy()  # as many rows as the array is long


def _numbers(column: pa.Array) -> np.ndarray:
    """The rows of FEATURES numbers in all values of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, FEATURES)


def _fit(rows: DataFrame, group: int) -> Ranker:
    """``fit_ranker`` over all rows of (label, place, x): each row meets all of the other label in a group of about ``group`` rows.

    Both labels are dealt to the groups by turns in the order of ``place``, and rows of a label with fewer rows than there are groups serve in several,
    so each row stands in a pair, and pairs are as many as rows times half a group.  Rows of one group or fewer all meet.  Each pass gives one array of fixed length.
    """
    n, good = (r := rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("good")).first())["n"], r["good"]
    if not n:
        return Ranker(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES))
    centre = _totals(rows.select("x"), lambda b: _numbers(b["x"]).sum(axis=0)) / n
    scale = np.sqrt(_totals(rows.select("x"), lambda b: ((_numbers(b["x"]) - centre) ** 2).sum(axis=0)) / n)
    model = Ranker(centre, np.where(scale > 1e-9, scale, 1.0), np.zeros(FEATURES))
    if not good or good == n:
        return model
    groups = max(1, -(-n // group))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        x, label = _standard(_numbers(table["x"]), model.centre, model.scale), table["label"].to_numpy()
        return pa.table({"good": [x[label == 1].tobytes()], "bad": [x[label == 0].tobytes()]}, schema=pa.schema([("good", pa.binary()), ("bad", pa.binary())]))

    placed = [number_rows(rows.where(F.col("label") == k), [F.col("place")], "_k").withColumn("_of", F.lit(min(m, groups))) for k, m in ((1, good), (0, n - good))]
    turns = F.sequence(F.pmod("_k", F.col("_of")), F.lit(groups - 1).cast("long"), F.col("_of").cast("long"))
    dealt = placed[0].unionByName(placed[1]).select(F.explode(turns).alias("_g"), "label", "x")
    packed = cut(dealt.groupBy("_g").applyInArrow(pack, "good binary, bad binary"), "quality-groups")

    def size(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([sum(len(a) * len(b) for a, b in zip(batch["good"].to_pylist(), batch["bad"].to_pylist(), strict=True)) / (8 * FEATURES) ** 2])

    pairs, w = float(_totals(packed, size)[0]), model.weights
    for _ in range(STEPS):

        def derivatives(batch: pa.RecordBatch, w: np.ndarray = w) -> np.ndarray:
            total = np.zeros(FEATURES * (FEATURES + 1))
            for k in range(len(batch)):
                total += np.concatenate([s.reshape(-1) for s in pair_sums(_numbers(batch["good"].slice(k, 1)), _numbers(batch["bad"].slice(k, 1)), w)])
            return total

        found = _totals(packed, derivatives)
        w = _newton(w, found[:FEATURES], found[FEATURES:].reshape(FEATURES, FEATURES), pairs, RIDGE)
    model.weights = w
    discard(packed)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_numbers(batch["x"])))], names=["raw"])

    scores = cut(rows.select("x").mapInArrow(raw, "raw double"), "quality-raw")
    model.cut = float(quantiles(scores, [], "raw", {"cut": (n - good) / n}).first()["cut"])
    model.unit = float(max(scores.agg(F.stddev_pop("raw")).first()[0], 1e-9))
    discard(scores)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 512) -> DataFrame:
    """One row for each row of ``docs``: (id, score, predicted).

    Learns from all rows that are ``usable`` and have a label 0 or 1, in groups of about ``most`` rows, in which each two rows of different labels are a pair; an
    id with several labels has the largest, and the rows of a repeated id count each.  Scores whole texts from the text alone; null and empty texts get the score of a
    text without words.  No labels, or only one label: every score is THRESHOLD.  Extra columns are ignored.
    """
    usable = F.lit(True) if usable is None else usable
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    lead = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = lead.schema["id"].dataType.simpleString()

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("place"), pa.array([x.tobytes() for x in text_features(part.column("text"))], pa.binary())], names=["id", "place", "x"])

    # the labels' side has no texts, so the documents' texts become numbers before the join
    own = docs.where(usable).select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("place"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    learn = own.mapInArrow(numbers, f"id {kind}, place long, x binary").join(known, "id").select("label", "place", "x")
    learn = cut(learn, "quality-rows")
    model = _fit(learn, most)
    discard(learn)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", 1 << 20):
                score = shared.value.score(text_features(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score)], names=["id", "score"])

    return lead.mapInArrow(run, f"id {kind}, score double").select(F.col("id").alias(id_col), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
