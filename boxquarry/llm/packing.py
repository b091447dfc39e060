"""Best-fit packing by minimum bin slack.

Token lengths are at most the sequence length, so the whole table enters the plan as one count for each
length.  The plan repeats: seed a bin with the longest length left, find the fullest feasible
combination for the rest by subset sums over the available lengths (one bit for each sum), and remove it as many
times as its lengths last.  Pieces are then numbered within their length, over all partitions, and take the
plan's slots in that order; texts and token ids are never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from boxquarry.llm.arrow_batches import byte_slices
from boxquarry.llm.storage import cut
from boxquarry.llm.text_hashing import segment_hashes, utf8_buffers

LENGTH, END_ID = 4096, 1


# Kinds of bytes: white space, letters (a-z, A-Z and precomposed Latin letters), others of ASCII, and those that may change the
# meaning of a neighbour: other characters beyond ASCII, contractions, special tokens.
_SPACE, _LETTER, _OTHER, _JOIN = range(4)
_KINDS = np.full(256, _OTHER, dtype=np.uint8)
_KINDS[0x41:0x5B] = _KINDS[0x61:0x7B] = _KINDS[0x80:] = _LETTER
_KINDS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KINDS[list(b"'<|")] = _JOIN


def _byte_kinds(data: np.ndarray) -> np.ndarray:
    kinds = _KINDS[data]
    high = np.flatnonzero(data >= 0xC2)
    follows = data[np.minimum(high + 1, len(data) - 1)]
    lead = data[high]
    odd = high[(lead != 0xC3) | (follows == 0x97) | (follows == 0xB7)]
    for k in range(4):  # the character's own bytes
        at = odd + k
        at = at[at < len(data)]
        kinds[at if not k else at[(data[at] & 0xC0) == 0x80]] = _JOIN
    return kinds


class TextEncoder:
    """Token ids of whole texts, by parts that the tokenizer treats each by itself, each looked up once.

    The tokenizer lower-cases, cuts texts at white space, drops it, and then cuts runs of letters from others.  So a text is cut at
    ASCII white space and between a letter and another character of ASCII, but not beside characters that may
    change a neighbour's meaning; the ids of a text are those of its parts one after another.  About ``most`` parts are remembered.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, dtype=bool)
        self.ends[[n for t, n in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        self.starts, self.counts = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def _remember(self, hashes: list[int], ids: np.ndarray, counts: np.ndarray) -> None:
        at, upto = len(self.known), len(self.known) + len(hashes)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while upto > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        self.ids[self.used : self.used + len(ids)] = ids
        self.counts[at:upto] = counts
        self.starts[at:upto] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.known.update(zip(hashes, range(at, upto), strict=True))

    def _encode_each(self, hashes: list[int], parts: list[bytes]) -> None:
        found = [f.ids for f in self.tokenizer.encode_batch([p.decode("utf-8", "replace") for p in parts], add_special_tokens=False)]
        self._remember(hashes, np.array([i for ids in found for i in ids], dtype="<u4"), np.array([len(ids) for ids in found], dtype=np.int64))

    def _encode_words(self, hashes: list[int], words: list[bytes]) -> None:
        """Runs of letters, as one text: each ends with its only token that ends a word."""
        ids = np.array(self.tokenizer.encode(b" ".join(words).decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(words):
            self._encode_each(hashes, words)
        else:
            self._remember(hashes, ids, np.diff(ends, prepend=-1))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these texts one after another, and each text's bounds among them."""
        data, bounds = utf8_buffers(column)
        if not len(data):
            return np.zeros(0, dtype="<u4"), np.zeros(len(bounds), dtype=np.int64)
        kinds = _byte_kinds(data)
        inside = kinds != _SPACE
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (kinds[1:] + kinds[:-1] == _LETTER + _OTHER) & (kinds[1:] != kinds[:-1]) & (kinds[1:] != _JOIN) & (kinds[:-1] != _JOIN)
        first = bounds[:-1][bounds[:-1] < bounds[1:]]
        begins[first] = inside[first]
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.zeros(0, dtype="<u4"), np.zeros(len(bounds), dtype=np.int64)
        hashes = segment_hashes(data, inside, starts)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        names = distinct.tolist()
        if len(self.known) > self.most:
            self._forget()
        fresh = [k for k, h in enumerate(names) if h not in self.known]
        if fresh:
            stops = np.append(starts[1:], len(data))
            joined = np.add.reduceat((kinds == _JOIN).astype(np.int64), starts)
            simple: tuple[list[int], list[bytes]] = ([], [])
            odd: tuple[list[int], list[bytes]] = ([], [])
            for k in fresh:
                n = where[k]
                part = data[starts[n] : stops[n]].tobytes().rstrip(b" \t\n\r\x0b\x0c")
                to = simple if kinds[starts[n]] == _LETTER and not joined[n] else odd
                to[0].append(names[k])
                to[1].append(part)
            if simple[0]:
                self._encode_words(*simple)
            if odd[0]:
                self._encode_each(*odd)
        known = self.known
        at = np.array([known[h] for h in names], dtype=np.int64)[back]
        counts = self.counts[at]
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(self.starts[at] - (ends - counts), counts) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(starts, bounds)]


_ENCODERS: dict[str, TextEncoder] = {}


def encoder_for(path: str) -> TextEncoder:
    """One encoder for each worker process: the vocabulary is read once, and known stretches serve later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of the pieces of each row's token ids."""
    kind = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                ids, bounds = encoder.encode(part.column("text"))
                rows, out = [], []
                for row in range(len(part)):
                    data = ids[bounds[row] : bounds[row + 1]].tobytes() + tail
                    for piece, start in enumerate(range(0, len(data), 4 * length)):
                        own = data[start : start + 4 * length]
                        rows.append(row)
                        out.append((piece, start // 4, len(own) // 4, zlib.crc32(own)))
                columns = [pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), kind, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows)), *columns], names=["id", *kind.names])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def fullest(available: dict[int, int], room: int) -> list[int]:
    """Lengths, each at most as often as available, whose sum is the largest that fits into ``room``."""
    steps: list[tuple[int, int]] = []
    before = [1]
    full = (1 << (room + 1)) - 1
    for size in sorted((s for s in available if s <= room), reverse=True):
        left, copies = min(available[size], room // size), 1
        while left:
            take = min(copies, left)
            steps.append((size, take))
            before.append((before[-1] | before[-1] << size * take) & full)
            left, copies = left - take, copies * 2
        if before[-1] >> room & 1:
            break
    total, chosen = before[-1].bit_length() - 1, []
    for (size, take), sums in zip(reversed(steps), reversed(before[:-1]), strict=True):
        if not sums >> total & 1:
            chosen += [size] * take
            total -= size * take
    return chosen


def minimum_bin_slack(counts: dict[int, int], length: int) -> list[tuple[list[int], int]]:
    """(lengths in one bin, number of such bins), fullest combinations first for the longest lengths."""
    left, plan = {k: v for k, v in counts.items() if v}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        others = {k: v for k, v in left.items() if v}
        content = [seed, *fullest(others, length - seed)]
        left[seed] += 1
        use: dict[int, int] = {}
        for size in content:
            use[size] = use.get(size, 0) + 1
        times = min(left[size] // n for size, n in use.items())
        for size, n in use.items():
            left[size] -= n * times
            if not left[size]:
                del left[size]
        plan.append((content, times))
    return plan


def plan_slots(plan: list[tuple[list[int], int]]) -> pd.DataFrame:
    """One row for each length of each kind of bin: its pieces numbered from ``lo`` on fill ``times`` bins from ``bin`` on."""
    used: dict[int, int] = {}
    rows, bins = [], 0
    for content, times in plan:
        offset = 0
        for size in content:
            lo = used.get(size, 0)
            rows.append((size, lo, times, bins, offset))
            used[size] = lo + times
            offset += size
        bins += times
    return pd.DataFrame(rows, columns=["length", "lo", "times", "bin", "offset"]).astype("int64")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each row: (id, piece, start, length, ids_crc32, sequence_id, offset).

    A row's ids are those of its text and then ``end_id``; null and empty texts have that one id.  Only longer rows
    are cut, into pieces of ``length``.  Sequences hold at most ``length`` ids, without gaps.  Repeated rows and ids are
    packed each by themselves; extra columns are ignored; an empty table has no pieces.
    """
    spark = docs.sparkSession
    # a piece's place in its partition numbers it there, whatever order the table is read in later
    cut_up = cut(pieces(docs, id_col, text_col, tokenizer, length, end_id).withColumn("place", F.monotonically_increasing_id()), "pieces")
    cut_up = cut_up.withColumn("task", F.shiftright("place", 33))
    by_task = cut_up.groupBy("length", "task").agg(F.count("*").alias("n"))
    # at most one row for each length: a bounded size whatever the table's
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan_slots(minimum_bin_slack(counts, length))
    if slots.empty:
        slots = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("length", "lo", "times", "bin", "offset")})
    tasks = W.partitionBy("length").orderBy("task")
    first = by_task.withColumn("before", F.sum("n").over(tasks) - F.col("n")).select("length", "task", "before")
    # numbered within (length, task), so that a length of many pieces is spread over tasks
    ranked = cut_up.withColumn("rank", F.row_number().over(W.partitionBy("length", "task").orderBy("place")) - 1)
    ranked = ranked.join(first, ["length", "task"]).withColumn("number", F.col("rank") + F.col("before"))

    by_length: dict[int, tuple[np.ndarray, ...]] = {int(k): tuple(g[c].to_numpy() for c in ("lo", "bin", "offset")) for k, g in slots.groupby("length")}
    shared = spark.sparkContext.broadcast(by_length)

    @F.pandas_udf("sequence_id long, offset long")
    def slot(size: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
        numbers, sizes = number.to_numpy(), size.to_numpy()
        for k in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == k)
            lo, bins, offsets = shared.value[k]
            at = np.searchsorted(lo, numbers[of], side="right") - 1
            sequence[of], offset[of] = bins[at] + numbers[of] - lo[at], offsets[at]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("slot", slot("length", "number"))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "slot.sequence_id", "slot.offset")
