"""Language identification with string kernels.

The kernel of two texts counts the byte n-grams (n from 1 to 3, A-Z lower-cased) that are present in both, over the
geometric mean of their own counts (blended-spectrum presence kernel; only n-grams of landmark texts enter).
Nystroem landmarks turn it into features, one-versus-rest kernel ridge regression gives each language a score, and
whole texts are scored by products of a batch's presence matrix with the landmarks'.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from boxquarry.llm.arrow_batches import byte_slices
from boxquarry.llm.text_hashing import LOWER, utf8_buffers

UNKNOWN = "und"

#: n-grams that each language has at least, however many languages there are
LEAST_GRAMS = 64

#: texts in one matrix of presences: 16 MB with 8192 n-grams
MOST_ROWS = 512


def gram_codes(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams inside texts, and their texts."""
    data, bounds = utf8_buffers(column)
    low = LOWER[data].astype(np.int32)
    count = max(0, len(low) - n + 1)
    codes = low[:count].copy()
    for k in range(1, n):
        codes = (codes << 8) | low[k : k + count]
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = owner[:count] == owner[n - 1 :] if count else np.zeros(0, dtype=bool)
    return codes[inside], owner[:count][inside]


def gram_sets(column: pa.Array) -> list[np.ndarray]:
    """For each whole text its different n-grams, as 4 * code + n: all that the kernel sees of it."""
    found = [np.unique(owner.astype(np.int64) << 32 | codes.astype(np.int64) * 4 + n) for n in (1, 2, 3) for codes, owner in [gram_codes(column, n)]]
    every = np.sort(np.concatenate(found))
    return np.split((every & 0xFFFFFFFF).astype(np.int32), np.searchsorted(every >> 32, np.arange(1, len(column))))


class Presence:
    """Which of a fixed set of n-grams each text has; it is chosen from the sets of landmark texts."""

    def __init__(self, sets: list[np.ndarray], languages: list[str], most: int):
        names, group = np.unique(np.array(languages, dtype=object).astype(str), return_inverse=True)
        groups = len(names)
        grams, place = np.unique(np.concatenate([np.zeros(0, dtype=np.int32), *sets]), return_inverse=True)
        owner = np.repeat(group, [len(x) for x in sets])
        # how many landmark texts of each language have each n-gram; only those that occur are held
        own, count = np.unique(place * max(groups, 1) + owner, return_counts=True)
        gram, lang = grams[own // max(groups, 1)], own % max(groups, 1)
        size, code = gram % 4, gram // 4
        # the place of each n-gram among its language's, most texts first, ties by n and code
        order = np.lexsort((code, size, -count, lang))
        held = lang[order]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(held, held)
        # languages take turns: the first of each, then the second of each
        turn = np.lexsort((code, size, -count, rank))
        _, first = np.unique(gram[turn], return_index=True)
        chosen = turn[np.sort(first)][: max(most, LEAST_GRAMS * groups)]
        self.size = len(chosen)
        self.codes = [code[chosen[size[chosen] == n]] for n in (1, 2, 3)]
        self._tables: list[np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    @property
    def tables(self) -> list[np.ndarray]:
        if self._tables is None:
            self._tables, at = [], 0
            for n, codes in enumerate(self.codes):
                table = np.full(256 ** (n + 1), -1, dtype=np.int16 if self.size < 32767 else np.int32)
                table[codes] = np.arange(at, at + len(codes))
                at += len(codes)
                self._tables.append(table)
        return self._tables

    def matrix(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), self.size), dtype=np.float32)
        flat = out.reshape(-1)
        for n, table in enumerate(self.tables, 1):
            codes, owner = gram_codes(column, n)
            slot = table[codes]
            known = slot >= 0
            flat[owner[known] * self.size + slot[known]] = 1
        return out

    def matrix_of(self, sets: list[np.ndarray]) -> np.ndarray:
        """The rows of ``matrix`` of the texts with these sets."""
        out = np.zeros((len(sets), self.size), dtype=np.float32)
        for row, grams in zip(out, sets, strict=True):
            for n, table in enumerate(self.tables, 1):
                slot = table[grams[grams % 4 == n] // 4]
                row[slot[slot >= 0]] = 1
        return out


@dataclass
class LanguageModel:
    languages: list[str]
    presence: Presence
    landmarks: np.ndarray  # one column for each landmark, over the root of its count
    weights: np.ndarray

    def kernel(self, own: np.ndarray) -> np.ndarray:
        return (own @ self.landmarks) / np.sqrt(np.maximum(own.sum(axis=1), 1))[:, None]

    def scores(self, column: pa.Array) -> np.ndarray:
        # very short texts are many to a slice, and each has a row as long as there are n-grams
        each = [self.kernel(self.presence.matrix(column.slice(k, MOST_ROWS))) for k in range(0, max(len(column), 1), MOST_ROWS)]
        return np.concatenate(each).astype(np.float64) @ self.weights


def fit(sets: list[np.ndarray], languages: list[str], landmarks: int = 40, ridge: float = 1e-3, most_grams: int = 8192) -> LanguageModel:
    """A model from the sets of texts in order of preference: the first ``landmarks`` texts of each language are the landmarks.

    Its n-grams are those of the most landmark texts of each language in turn: ``most_grams``, or LEAST_GRAMS a language if that is more.
    """
    names = sorted(set(languages))
    chosen, taken = [], dict.fromkeys(names, 0)
    for k, lang in enumerate(languages):
        if taken[lang] < landmarks:
            taken[lang] += 1
            chosen.append(k)
    presence = Presence([sets[k] for k in chosen], [languages[k] for k in chosen], most_grams)
    marks = presence.matrix_of([sets[k] for k in chosen])
    marks = (marks / np.sqrt(np.maximum(marks.sum(axis=1), 1))[:, None]).T.copy()
    model = LanguageModel(names, presence, marks, np.zeros((len(chosen), len(names))))
    values, vectors = np.linalg.eigh((marks.T @ marks).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    kernel = np.concatenate([model.kernel(presence.matrix_of(sets[k : k + 64])) for k in range(0, len(sets), 64)])
    features = kernel.astype(np.float64) @ root
    wanted = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # each language weighs the same, however many texts it has
    weight = np.array([1 / languages.count(x) for x in languages])[:, None] * len(sets) / len(names)
    solved = np.linalg.solve(features.T @ (features * weight) + ridge * len(sets) * np.eye(features.shape[1]), features.T @ (wanted * weight))
    model.weights = root @ solved
    return model


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, usable: Column, per_language: int, most_rows: int) -> pd.DataFrame:
    """(lang, place, grams): rows of every language by a hash of id and text: ``per_language`` of each, fewer if that makes over ``most_rows``, one at least.

    Rows are counted each, whatever their ids.  Of a whole text its different n-grams are kept, so a long text has no more of them than there are n-grams.
    """
    scale = 1 << 30
    place = F.pmod(F.xxhash64(F.lit("language-id"), F.col(id_col).cast("string"), F.col(text_col)), F.lit(scale))
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}")).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), place.alias("place"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least")).collect()  # one row a language
    if not counts:
        return pd.DataFrame({"lang": [], "place": [], "grams": []})
    each = max(1, min(per_language, most_rows // len(counts)))
    # about one and a half times as many rows of each language, and that with the smallest hash at least
    shares = docs.sparkSession.createDataFrame([(r["lang"], max(r["least"] + 1, min(scale, int(scale * (1.5 * each + 20) / r["n"])))) for r in counts], "lang string, share long")
    drawn = rows.join(F.broadcast(shares), "lang").where(F.col("place") < F.col("share")).select("lang", "place", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("place"), pa.array(gram_sets(part.column("text")), pa.list_(pa.int32()))], names=["lang", "place", "grams"])

    # where very many rows are alike they share a hash: the window's limit cuts them down in each task
    first = F.row_number().over(W.partitionBy("lang").orderBy("place", "grams"))
    found = drawn.mapInArrow(grams, "lang string, place long, grams array<int>").withColumn("r", first).where(F.col("r") <= each).drop("r").toPandas()
    return found.sort_values(["place", "lang"], kind="stable").reset_index(drop=True)


def identify_languages(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 250, most_rows: int = 16_000, with_rows: bool = False, least_score: float = 0.0) -> DataFrame:
    """One row for each row of ``docs``: (id, lang_pred, score), and (with_rows) ``row``, a struct of its own columns, and ``learned``.

    Learns every language from a bounded sample of its rows that are ``usable``: at most ``per_language`` rows a language and
    ``most_rows`` in all, but one of each language at least, each text in full; predicts each whole text from the text alone.  Of equal
    best scores the language that comes first by name is taken.
    lang_pred is ``und`` with score 0 where the text is null or has no letter, or nothing could be learned, in which case ``learned`` is false;
    it is ``und`` also where the score is under ``least_score``.  score is the best language's regression value, from -1..1 onto 0..1.  Repeated
    rows are each answered; extra columns are ignored.
    """
    usable = F.lit(True) if usable is None else usable
    sample = training_sample(docs, id_col, text_col, lang_col, usable, per_language, most_rows)
    most_marks = max(1, min(40, 2560 // max(1, sample["lang"].nunique())))
    model = fit([np.asarray(x, dtype=np.int32) for x in sample["grams"]], sample["lang"].tolist(), most_marks) if len(sample) else None
    # its size is set by the parameters: landmarks times n-grams
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lead = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("letters"), *([F.struct(*docs.columns).alias("row")] if with_rows else []))
    kept = [c for c in lead.columns if c not in ("text", "letters")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in byte_slices(batch, "text", 1 << 19):
                n, letters = len(part), part.column("letters").to_numpy(zero_copy_only=False)
                names, best = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
                if known is not None:
                    scores = known.scores(part.column("text"))
                    names = np.where(letters, np.array(known.languages, dtype=object)[scores.argmax(axis=1)], UNKNOWN)
                    best = np.where(letters, np.clip((scores.max(axis=1) + 1) / 2, 0, 1), 0.0)
                    names = np.where(best < least_score, UNKNOWN, names)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(names, pa.string()), pa.array(best, pa.float64())], names=[*kept, "lang_pred", "score"])

    schema = lead.select(*kept).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    found = lead.mapInArrow(run, schema).withColumnRenamed("id", id_col)
    return found.withColumn("learned", F.lit(model is not None)) if with_rows else found
