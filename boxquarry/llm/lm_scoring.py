"""Scores of texts by an interpolated modified Kneser-Ney model of three words.

The model is counted in Spark jobs and kept as sorted arrays of hashes with their counts, files in the shared folder that workers map
into memory and search.  It is built in four steps:

1. words: counted, sorted by hash; a word's number is its place among all.
2. runs of three words: counted in each task, dealt out by their middle word, merged and written.  All that begins with a pair shares its
   second word as middle word, and all that ends with one its first, so the shard also knows all about these pairs and writes them.
3. pairs of a middle word with more runs than a shard holds, which is dealt to several shards: what these know about each pair is added up.
4. single words: what pairs tell about them is added up.

Every shard is bounded by the number of its runs.  Shards are dealt to parts, of which there are 128, or twice the square root of the number of
shards if that is more, and the shards of a part lie one after another in its files.  So both the look-ups of some megabytes of text, and the rows that
they are counted into, go by parts and hardly grow with the corpus.  Each file is written by one task, under another name first, so that a task that
is repeated leaves the same file.
"""

from __future__ import annotations

import math
import os
import pickle
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxquarry.llm.arrow_batches import byte_slices
from boxquarry.llm.storage import cut, new_path
from boxquarry.llm.text_hashing import SPACE_WORDS, mix, word_hashes

#: Numbers of what is no word of the training texts: the place before a text's first word, and any other word.
BEFORE, UNKNOWN = 2**32 - 1, 2**32 - 2
#: The hash of the end of a text, which counts as a word.
END = np.int64(0x5EED0E0D)
_WORD, _LAST = np.uint64(32), np.uint64(2**32 - 1)
#: Parts that shards are dealt to, unless twice the square root of their number is more.
PARTS = 128


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(np.uint64) << _WORD | second.astype(np.uint64)


def run_hash(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    return mix(mix(pair_key(first, second)) + third.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def local_folder(path: str) -> str:
    """The folder as the file system of driver and executors knows it: files are mapped into memory from there."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"the model's folder has to be mounted as a file system on all machines: {path}")
    return path


def _least(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    for kind, values in arrays.items():
        path = f"{folder}/{name}.{kind}.npy"
        own = f"{path}.{TaskContext.get().taskAttemptId()}"
        with open(own, "wb") as file:
            np.save(file, values)
        os.replace(own, path)


class Tables:
    """Writes tables of hashes: of each part one file for a kind of array, to which its shards are added one after another."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def add(self, name: str, shard: int, hashes: np.ndarray, **columns: np.ndarray) -> None:
        """Entries in the order of their hashes: where each value of a hash's first bits begins, and its next 32 bits.

        About 16 entries share first bits, so a hash that isn't there is taken for another with a chance of 4e-9.  A column has a byte
        for each entry; numbers from 255 on are listed by place.
        """
        if not len(hashes):
            return
        key = f"{self.model.folder}/{name}-{shard % self.model.parts}"
        if key not in self.open:
            os.makedirs(self.model.folder, exist_ok=True)
            own = TaskContext.get().taskAttemptId()
            self.open[key] = {kind: open(f"{key}.{kind}.{own}", "wb") for kind in ("offsets", "rest", *columns)}, np.zeros((4, -(-self.model.shards // self.model.parts)), dtype=np.int64), {kind: [] for kind in columns}
        files, index, large = self.open[key]
        bits = max(0, (len(hashes) // 16).bit_length() - 1)
        order = np.argsort(hashes)
        hashes = hashes[order]
        tops = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), dtype=np.uint64)
        offsets = np.searchsorted(tops, np.arange((1 << bits) + 1, dtype=np.uint64))
        first = files["rest"].tell() // 4
        index[:, shard // self.model.parts] = len(hashes), bits, files["offsets"].tell() // 4, first
        offsets.astype(np.uint32).tofile(files["offsets"])
        (hashes >> np.uint64(32 - bits)).astype(np.uint32).tofile(files["rest"])
        for kind, values in columns.items():
            values = values[order].astype(np.uint64)
            np.minimum(values, 255).astype(np.uint8).tofile(files[kind])
            many = np.flatnonzero(values >= 255)
            large[kind].append(np.stack([many.astype(np.uint64) + np.uint64(first), values[many]]))

    def close(self) -> None:
        for key, (files, index, large) in self.open.items():
            for kind, file in files.items():
                file.close()
                os.replace(file.name, f"{key}.{kind}")
            folder, name = key.rsplit("/", 1)
            _save(folder, name, index=index, **{f"{kind}-large": np.concatenate(x, axis=1) for kind, x in large.items()})
        self.open = {}


_KINDS = {"offsets": np.uint32, "rest": np.uint32}


class Shelf:
    """Arrays mapped into memory, a bounded number of files at a time; a worker keeps one for its later tasks."""

    def __init__(self, most: int = 8192):
        self.most, self.open = most, OrderedDict()

    def get(self, path: str) -> np.ndarray:
        if path not in self.open:
            while len(self.open) >= self.most:
                self.open.popitem(last=False)
            if not os.path.exists(path):  # a part without entries has no file
                found = np.zeros(0, dtype=np.uint8)
            elif path.endswith(".npy"):
                found = np.load(path, mmap_mode="r")
            else:
                found = np.memmap(path, dtype=_KINDS.get(path.rsplit(".", 1)[1], np.uint8), mode="r")
            self.open[path] = found.view(np.ndarray)
        self.open.move_to_end(path)
        return self.open[path]


_SHELF = Shelf()


def _search(name: str, shards: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of these hashes their shards of a part hold (by number there), and where: by first bits and then by halving, all at a time."""
    index = _SHELF.get(f"{name}.index.npy")
    if not len(index):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    offsets, rest = _SHELF.get(f"{name}.offsets"), _SHELF.get(f"{name}.rest")
    sizes, bits, places, first = index[:, shards]
    there = np.flatnonzero(sizes)
    hashes, bits, places, first = hashes[there], bits[there].astype(np.uint64), places[there], first[there]
    # by one bit and the others, as no bits at all are not to be a shift by 64
    at = places + (hashes >> np.uint64(1) >> np.uint64(63) - bits).astype(np.int64)
    wanted = (hashes >> np.uint64(32) - bits).astype(np.uint32)
    lo, end = offsets[at] + first, offsets[at + 1] + first
    hi = end
    while (lo < hi).any():
        middle = (lo + hi) >> 1
        less = (rest[np.minimum(middle, len(rest) - 1)] < wanted) & (lo < hi)
        lo, hi = np.where(less, middle + 1, lo), np.where(less | (lo >= hi), hi, middle)
    hit = lo < end
    hit[hit] = rest[lo[hit]] == wanted[hit]
    return there[hit], lo[hit]


def look_up(model: Model, level: str, shards: np.ndarray, hashes: np.ndarray, kinds: list[str]) -> list[np.ndarray]:
    """The entries of these hashes, each in its shard; 0 where there is none."""
    out = [np.zeros(len(hashes), dtype=np.int64) for _ in kinds]
    parts = shards % model.parts
    order = np.argsort(_least(parts), kind="stable")
    bounds = np.flatnonzero(np.diff(parts[order], prepend=-1, append=-1))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        some = order[lo:hi]
        name = f"{model.folder}/{level}-{parts[some[0]]}"
        hit, at = _search(name, shards[some] // model.parts, hashes[some])
        for values, kind in zip(out, kinds, strict=True):
            if len(hit):
                found = _SHELF.get(f"{name}.{kind}")[at].astype(np.int64)
                if len(many := np.flatnonzero(found == 255)):
                    places, numbers = _SHELF.get(f"{name}.{kind}-large.npy")
                    found[many] = numbers[np.searchsorted(places, at[many].astype(np.uint64))]
                values[some[hit]] = found
    return out


def _spans(numbers: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each number of an ascending array, and where it stands."""
    bounds = np.flatnonzero(np.diff(numbers, prepend=-1, append=np.iinfo(np.int64).max))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield int(numbers[lo]), slice(lo, hi)


@dataclass
class Words:
    """Words by hash: files of ranges, one row a file here, and the number that a file's first word has."""

    folder: str
    firsts: np.ndarray
    parts: np.ndarray
    starts: np.ndarray
    total: int
    types: int
    texts: int = 0

    def _file(self, k: int, kind: str) -> np.ndarray:
        return _SHELF.get(f"{self.folder}/words-{self.parts[k]}.{kind}.npy")

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number and count of each different word, UNKNOWN and 0 where it wasn't learned; and which of these each given one is."""
        distinct, back = np.unique(hashes, return_inverse=True)
        numbers, counts = np.full(len(distinct), UNKNOWN, dtype=np.int64), np.zeros(len(distinct), dtype=np.int64)
        if len(self.firsts):
            files = np.maximum(np.searchsorted(self.firsts, distinct, side="right") - 1, 0)
            for k, some in _spans(files):
                known = self._file(k, "hash")
                at = np.searchsorted(known, distinct[some])
                at[at == len(known)] = 0
                hit = known[at] == distinct[some]
                numbers[some][hit] = self.starts[k] + at[hit]
                counts[some][hit] = self._file(k, "n")[at[hit]]
        return numbers, counts, back

    def often(self, numbers: np.ndarray) -> np.ndarray:
        """The count of each numbered word; for BEFORE, the number of texts; for UNKNOWN, 0."""
        distinct, back = np.unique(numbers, return_inverse=True)
        counts = np.where(distinct == BEFORE, self.texts, 0).astype(np.int64)
        files = np.searchsorted(self.starts, distinct[distinct < UNKNOWN], side="right") - 1
        for k, some in _spans(files):
            counts[some] = self._file(k, "n")[distinct[some].astype(np.int64) - self.starts[k]]
        return counts[back]


@dataclass
class Model:
    words: Words
    folder: str
    shard: int
    shards: int
    discounts: dict[int, np.ndarray] = field(default_factory=dict)
    # all different pairs, and how many words have one, two and more words before them
    pairs: int = 0
    spread: tuple[int, int, int] = (0, 0, 0)

    @property
    def parts(self) -> int:
        return min(self.shards, max(PARTS, 2 * math.isqrt(self.shards)))

    def salts(self, middle: np.ndarray) -> np.ndarray:
        """Over how many shards the runs with this middle word are dealt."""
        return (1 + self.words.often(middle) // self.shard).astype(np.uint64)

    def shard_of(self, keys: np.ndarray, salt: np.ndarray | np.uint64 = np.uint64(0)) -> np.ndarray:
        return (mix(keys.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + salt) % np.uint64(self.shards)).astype(np.int64)


def _sequences(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text and its end, as hashes, and each text's bounds among them."""
    hashes, bounds = word_hashes(part.column("text"), SPACE_WORDS)
    return np.insert(hashes.view(np.int64), bounds[1:], END), bounds + np.arange(len(bounds))


def _runs(numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the number of the one before it and of the one before that."""
    first, starts = np.empty_like(numbers), bounds[:-1]
    second = np.empty_like(numbers)
    second[1:], first[2:] = numbers[:-1], numbers[:-2]
    second[starts] = first[starts] = BEFORE
    later = starts[np.diff(bounds) > 1] + 1
    first[later] = BEFORE
    return first, second


def _totals(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sums of each column."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ keys.dtype.type(1))) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[starts], *(np.add.reduceat(c[order], starts) if len(keys) else c for c in columns)


#: What a row of counts is about; rows of a level below the step's own go through it.
_TALLY, _WORD_OWN, _WORD_AFTER, _PAIR_OWN, _PAIR_AFTER, _RUN = range(6)
_ROW = "level long, part int, shard long, data binary"
#: Entries of a level that are gathered before they are packed into rows.
GATHERED = 1 << 18


def _pack(columns: list[np.ndarray]) -> bytes:
    """Whole numbers of one length, each byte's place by itself, so that they compress."""
    kept = [_least(c) for c in columns]
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in kept)
    return pickle.dumps((len(kept[0]), [c.itemsize for c in kept], zstandard.ZstdCompressor(level=1).compress(raw)))


def _unpack(data: bytes) -> list[np.ndarray]:
    n, sizes, packed = pickle.loads(data)
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8), 0, []
    for size in sizes:
        planes = raw[at : at + n * size].reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{size}").ravel().astype(np.uint64))
        at += n * size
    return out


def _rows(model: Model, level: int, shards: np.ndarray, columns: list[np.ndarray], single: bool = False) -> Iterator[pa.RecordBatch]:
    """One row a part with its entries and their shards; where a part is a shard, or each shard is to be ``single``, one row a shard."""
    single |= model.shards == model.parts
    parts, places = shards % model.parts, shards // model.parts
    order = np.argsort(_least(parts * (-(-model.shards // model.parts)) + places), kind="stable")
    shards = shards[order]
    bounds = np.flatnonzero(np.diff(shards if single else parts[order], prepend=-1, append=-1))
    columns = [c[order] for c in columns]
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own, some = int(shards[lo]), [c[lo:hi] for c in columns]
        yield _row(model, level, own, _pack(some)) if single else _row(model, level, own, _pack([shards[lo:hi], *some]), mixed=True)


def _row(model: Model, level: int, shard: int, data: bytes, mixed: bool = False) -> pa.RecordBatch:
    """A row of a shard, or of several of its part."""
    return pa.RecordBatch.from_arrays([pa.array([level]), pa.array([shard % model.parts], pa.int32()), pa.array([-1 if mixed else shard]), pa.array([data], pa.binary())], names=["level", "part", "shard", "data"])


class Gathered:
    """Entries on their way to rows, so that few of them don't make a row each."""

    def __init__(self, model: Model, single: bool = False):
        self.model, self.single, self.held, self.size = model, single, {}, Counter()

    def add(self, level: int, shards: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.held.setdefault(level, []).append([_least(x) for x in (shards, *columns)])
        self.size[level] += len(shards)
        if self.size[level] >= GATHERED:
            yield from self.flush(level)

    def flush(self, *levels: int) -> Iterator[pa.RecordBatch]:
        for level in levels or list(self.held):
            shards, *columns = (np.concatenate(x) for x in zip(*self.held.pop(level), strict=True))
            self.size[level] = 0
            yield from _rows(self.model, level, shards.astype(np.int64), columns, self.single)


def _tally(model: Model, words: int, shard: int, values: np.ndarray) -> pa.RecordBatch:
    """Of a shard's counts of so many words: how many are 1 to 4, how many there are, and their sum."""
    few = np.bincount(np.minimum(values, 5).astype(np.int64), minlength=6)[1:5].tolist()
    return _row(model, _TALLY, shard, pickle.dumps([words, *few, int(np.count_nonzero(values)), int(values.sum())]))


def _single(model: Model) -> Callable:
    """Rows of several shards, some at a time, as rows of one shard each; others go through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered(model, single=True)
        for batch in batches:
            for k, shard in enumerate(batch.column("shard").to_pylist()):
                if shard >= 0:
                    yield batch.slice(k, 1)
                else:
                    shards, *columns = _unpack(batch.column("data")[k].as_py())
                    yield from gathered.add(batch.column("level")[k].as_py(), shards, columns)
        yield from gathered.flush()

    return run


def _step(model: Model, own: dict[int, Callable[[int, list[np.ndarray], Tables, Gathered], Iterator[pa.RecordBatch]]]) -> Callable:
    """Calls the function of its level with each shard and its entries, all rows' one after another; rows of other levels go through.

    Rows come sorted by level, part and shard, so one shard is held at a time, and what its task writes is of one part at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tables, gathered = None, [], Tables(model), Gathered(model)

        def close(key: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
            if held:
                entries = [np.concatenate(x) for x in zip(*held, strict=True)]
                held.clear()
                yield from own[at[0]](at[1], entries, tables, gathered)
            if at and (key is None or (at[0], at[1] % model.parts) != (key[0], key[1] % model.parts)):
                tables.close()

        for batch in batches:
            for k, key in enumerate(zip(batch.column("level").to_pylist(), batch.column("shard").to_pylist(), strict=True)):
                if key[0] not in own:
                    yield batch.slice(k, 1)
                    continue
                if key != at:
                    yield from close(key)
                    at, held = key, []
                held.append(_unpack(batch.column("data")[k].as_py()))
        yield from close(None)
        yield from gathered.flush()

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n.astype(np.int64))], names=["word", "n"])

    for batch in batches:
        for part in byte_slices(batch, "text"):
            held.append(_sequences(part)[0])
            size += len(held[-1])
            if size >= 1 << 21:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def learn_words(texts: DataFrame, folder: str) -> Words:
    """Counts all words and writes them as sorted arrays, a file for each range of hashes."""
    counted = texts.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    placed = counted.repartitionByRange("word").sortWithinPartitions("word")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("word").to_numpy(), b.column("n").to_numpy()) for b in batches if len(b)]
        if held:
            words, n = (np.concatenate(x) for x in zip(*held, strict=True))
            part = TaskContext.get().partitionId()
            _save(folder, f"words-{part}", hash=words, n=_least(n))
            yield pa.RecordBatch.from_pylist([{"part": part, "first": int(words[0]), "types": len(words), "total": int(n.sum())}])

    # one row for each partition of the sort
    files = cut(placed.mapInArrow(write, "part long, first long, types long, total long"), "words").toPandas().sort_values("first")
    types = files["types"].to_numpy()
    if types.sum() >= UNKNOWN:
        raise ValueError("more than 2^32 - 2 different words")
    words = Words(folder, files["first"].to_numpy(), files["part"].to_numpy(), np.cumsum(types) - types, int(files["total"].sum()), int(types.sum()))
    words.texts = int(words.find(np.array([END]))[1][0])
    return words


def _distinct_runs(first: np.ndarray, second: np.ndarray, third: np.ndarray, n: np.ndarray | None = None) -> list[np.ndarray]:
    """The distinct runs with the sums of their counts (one each, if none are given), in the order of middle, first and last word."""
    leads, back = np.unique(pair_key(second, first), return_inverse=True)
    keys = pair_key(back, third)
    order = None if n is None else np.argsort(keys)
    keys = np.sort(keys) if n is None else keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    counts = np.diff(starts, append=len(keys)).astype(np.uint64) if n is None else np.add.reduceat(n[order], starts)
    keys = keys[starts]
    lead = leads[(keys >> _WORD).astype(np.int64)]
    return [lead & _LAST, lead >> _WORD, keys & _LAST, counts]


def _count_runs(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            first, second, third = (np.concatenate(x) for x in zip(*held, strict=True))
            first, second, third, n = _distinct_runs(first, second, third)
            shards = model.shard_of(second, run_hash(first, second, third) % model.salts(second))
            yield from _rows(model, _RUN, shards, [first, second, third, n])

        for batch in batches:
            for part in byte_slices(batch, "text"):
                hashes, bounds = _sequences(part)
                distinct, _, back = model.words.find(hashes)
                numbers = distinct[back]
                held.append([x.astype(np.uint32) for x in (*_runs(numbers, bounds), numbers)])
                size += len(numbers)
                if size >= 3 << 19:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _spread(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each key: the sum of its counts, and how many of them are one, two and more."""
    one = lambda x: x.astype(np.uint64)
    return _totals(keys, n, one(n == 1), one(n == 2), one(n > 2))


_AFTER = ["sum", "ones", "twos", "more"]


def _save_pairs(tables: Tables, name: str, shard: int, own: tuple[np.ndarray, ...] | None, after: tuple[np.ndarray, ...] | None) -> None:
    """Pairs by their counts, and by what comes after them; a pair that one word follows once has no entry of the second kind."""
    if own is not None:
        tables.add(f"{name}own", shard, mix(own[0]), n=own[1])
    if after is not None:
        more = after[1] > 1
        tables.add(f"{name}after", shard, mix(after[0][more]), **{k: x[more] for k, x in zip(_AFTER, after[1:], strict=True)})


def _about_words(model: Model, gathered: Gathered, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What pairs and their counts tell about words: how many come before each, and the counts of what comes after."""
    own = _totals(keys & _LAST, np.ones(len(keys), dtype=np.uint64))
    yield from gathered.add(_WORD_OWN, model.shard_of(own[0]), list(own))
    after = _spread(keys >> _WORD, n)
    yield from gathered.add(_WORD_AFTER, model.shard_of(after[0]), list(after))


def _write_runs(model: Model) -> Callable:
    def runs(shard: int, entries: list[np.ndarray], tables: Tables, gathered: Gathered) -> Iterator[pa.RecordBatch]:
        first, second, third, n = _distinct_runs(*entries)
        entries.clear()  # as many rows again are worked out from the distinct ones
        tables.add("runs", shard, run_hash(first, second, third), n=n)
        yield _tally(model, 3, shard, n)
        # a pair counts by the different words before it; at a text's start, where there is none, by its occurrences
        own = _totals(pair_key(second, third), np.where(second == BEFORE, n, np.uint64(1)))
        after = _spread(pair_key(first, second), n)
        alone = model.salts(own[0] >> _WORD) == 1, model.salts(after[0] & _LAST) == 1
        _save_pairs(tables, "", shard, [x[alone[0]] for x in own], [x[alone[1]] for x in after])
        yield _tally(model, 2, shard, own[1][alone[0]])
        yield from _about_words(model, gathered, *(x[alone[0]] for x in own))
        for level, entries, mine in ((_PAIR_OWN, own, alone[0]), (_PAIR_AFTER, after, alone[1])):
            yield from gathered.add(level, model.shard_of(entries[0][~mine]), [x[~mine] for x in entries])

    return _step(model, {_RUN: runs})


def _write_pairs(model: Model) -> Callable:
    def own(shard: int, entries: list[np.ndarray], tables: Tables, gathered: Gathered) -> Iterator[pa.RecordBatch]:
        keys, n = _totals(*entries)
        _save_pairs(tables, "often-", shard, (keys, n), None)
        yield _tally(model, 2, shard, n)
        yield from _about_words(model, gathered, keys, n)

    def after(shard: int, entries: list[np.ndarray], tables: Tables, gathered: Gathered) -> Iterator[pa.RecordBatch]:
        _save_pairs(tables, "often-", shard, None, _totals(*entries))
        yield from ()

    return _step(model, {_PAIR_OWN: own, _PAIR_AFTER: after})


def _write_words(model: Model) -> Callable:
    def own(shard: int, entries: list[np.ndarray], tables: Tables, gathered: Gathered) -> Iterator[pa.RecordBatch]:
        keys, n = _totals(*entries)
        tables.add("word-own", shard, mix(keys), n=n)
        yield _tally(model, 1, shard, n)

    def after(shard: int, entries: list[np.ndarray], tables: Tables, gathered: Gathered) -> Iterator[pa.RecordBatch]:
        keys, *columns = _totals(*entries)
        tables.add("word-after", shard, mix(keys), **dict(zip(_AFTER, columns, strict=True)))
        yield from ()

    return _step(model, {_WORD_OWN: own, _WORD_AFTER: after})


def discounts(ones: int, twos: int, threes: int, fours: int) -> np.ndarray:
    """What is taken off counts of 0, 1, 2, and 3 or more; by fixed numbers where there are too few counts to tell."""
    if not (ones and twos and threes and fours):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = ones / (ones + 2 * twos)
    return np.clip([0.0, 1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes], 0, [0, 1, 2, 3])


_TALLIES = ["words", "ones", "twos", "threes", "fours", "entries", "sum"]


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.array([pickle.loads(x.as_py()) for x in batch.column("data")], dtype=np.int64).reshape(-1, len(_TALLIES))
        yield pa.RecordBatch.from_arrays([pa.array(counts[:, k]) for k in range(len(_TALLIES))], names=_TALLIES)


def learn(texts: DataFrame, shard: int = 1 << 20) -> Model:
    """A model of the column ``text`` without nulls; ``shard``: about how many runs of words a task holds at a time."""
    spark = texts.sparkSession
    folder = local_folder(new_path(spark, "language-model"))
    words = learn_words(texts, folder)
    model = Model(words, folder, shard, 1 + words.total // shard)
    rows = texts.mapInArrow(_count_runs(model), _ROW)
    tasks = min(model.parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for write in (_write_runs, _write_pairs, _write_words):
        dealt = rows.repartitionById(tasks, F.col("part") % tasks)
        # rows of a part hold several shards where there are more of these than parts; a task sorts them on disk, so it holds one shard at a time
        single = dealt if model.shards == model.parts else dealt.mapInArrow(_single(model), _ROW)
        rows = single.sortWithinPartitions("level", "part", "shard").mapInArrow(write(model), _ROW)
    tallies = cut(rows.mapInArrow(_tallies, ", ".join(f"{n} long" for n in _TALLIES)), "tallies")
    # one row for each number of words
    found = {r["words"]: r for r in tallies.groupBy("words").agg(*[F.sum(n).alias(n) for n in _TALLIES[1:]]).collect()}
    for k in (1, 2, 3):
        model.discounts[k] = discounts(*(found[k][n] if k in found else 0 for n in _TALLIES[1:5]))
    if 1 in found:
        one = found[1]
        model.pairs, model.spread = one["sum"], (one["ones"], one["twos"], one["entries"] - one["ones"] - one["twos"])
    return model


def _interpolated(lower: np.ndarray | float, own: np.ndarray, off: np.ndarray, total: np.ndarray, spread: list[np.ndarray]) -> np.ndarray:
    """Discounted shares of ``total``, and what was taken off, dealt out by ``lower``; where nothing was counted, ``lower`` itself."""
    left = sum(off[k + 1] * spread[k] for k in range(3))
    return np.where(total > 0, (np.maximum(own - off[np.minimum(own, 3)], 0) + left * lower) / np.maximum(total, 1), lower)


def _of_pairs(model: Model, level: str, keys: np.ndarray, middle: np.ndarray, often: np.ndarray, kinds: list[str]) -> list[np.ndarray]:
    """Entries of pairs with their middle word: in its shard, or, if it is one of those that are dealt to several, in the pair's."""
    spread = np.isin(middle, often)
    out = [np.zeros(len(keys), dtype=np.int64) for _ in kinds]
    for prefix, some in (("", np.flatnonzero(~spread)), ("often-", np.flatnonzero(spread))):
        shards = model.shard_of(keys[some] if prefix else middle[some])
        for values, found in zip(out, look_up(model, prefix + level, shards, mix(keys[some]), kinds), strict=True):
            values[some] = found
    return out


def log_probabilities(model: Model, numbers: np.ndarray, counts: np.ndarray, back: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The base-10 logarithm of each word's probability after the two before it; words as ``Words.find`` gives them."""
    starts = bounds[:-1]
    numbers, counts = np.append(numbers, BEFORE), np.append(counts, model.words.texts)

    def shifted(places: np.ndarray, first: int) -> np.ndarray:
        out = np.empty_like(places)
        out[1:] = places[:-1]
        out[starts] = first
        return out

    before = shifted(back, len(numbers) - 1)
    third, second, first = numbers[back], numbers[before], numbers[shifted(before, len(numbers) - 1)]
    shards = model.shard_of(numbers), mix(numbers.astype(np.uint64))
    own = look_up(model, "word-own", *shards, ["n"])[0][back]
    p = _interpolated(1 / (model.words.types + 1), own, model.discounts[1], np.full(len(own), model.pairs), list(model.spread))
    total, *spread = (x[before] for x in look_up(model, "word-after", *shards, _AFTER))
    # each pair once: as what ends with its last word, and, of the next word, as what comes before; at a text's start that is BEFORE twice
    pairs, which = np.unique(np.append(pair_key(second, third), pair_key(numbers[-1:], numbers[-1:])), return_inverse=True)
    often = numbers[counts >= model.shard]
    own = _of_pairs(model, "own", pairs, (pairs >> _WORD).astype(np.int64), often, ["n"])[0]
    total_after, ones, twos, more = _of_pairs(model, "after", pairs, (pairs & _LAST).astype(np.int64), often, _AFTER)
    # a pair that is known and has no entry is followed by one word, once
    once = (total_after == 0) & ((own > 0) | (pairs == pair_key(numbers[-1:], numbers[-1:])) & (model.words.total > 0))
    total_after, ones = np.where(once, 1, total_after), np.where(once, 1, ones)
    p = _interpolated(p, own[which[:-1]], model.discounts[2], total, spread)
    lead = shifted(which[:-1], which[-1])
    hashes = run_hash(first, second, third)
    salts = (1 + counts[before] // model.shard).astype(np.uint64)
    own = look_up(model, "runs", model.shard_of(second, hashes % salts), hashes, ["n"])[0]
    return np.log10(_interpolated(p, own, model.discounts[3], total_after[lead], [x[lead] for x in (ones, twos, more)]))


def score_texts(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", shard: int = 1 << 20) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity).

    Learns from the rows that are ``usable`` (null is no), all of them in full.  Tokens are runs of other than ASCII white space, A-Z
    lower-cased, and one end of the text; null texts are empty.  ``score`` is the model's base-10 logarithm of the text's probability, ``base_score``
    that of single words with one added to each count.  Repeated rows are learned and scored each; a table without usable rows gives
    every token the same probability, that of one unknown word.  Extra columns are ignored; an empty table has no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    train = docs if usable is None else docs.where(usable)
    model = learn(train.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), shard)

    def scores(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        total, types = model.words.total, model.words.types
        hashes, bounds = zip(*(_sequences(p) for p in parts), strict=True)
        bounds = np.append(0, np.cumsum(np.concatenate([np.diff(b) for b in bounds])))
        numbers, counts, back = model.words.find(np.concatenate(hashes))
        starts, sizes = bounds[:-1], np.diff(bounds)
        base = np.add.reduceat(np.log10((counts + 1) / (total + types + 1))[back], starts)
        score = np.add.reduceat(log_probabilities(model, numbers, counts, back, bounds), starts)
        known = np.add.reduceat((counts > 0).astype(np.int64)[back], starts)
        ids = pa.chunked_array([p.column("id") for p in parts]).combine_chunks()
        data = [ids, pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), total)), pa.array(base), pa.array(score), pa.array(10 ** np.minimum(-score / sizes, 300))]
        return pa.RecordBatch.from_arrays(data, names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # some megabytes of text at a time: words and pairs that repeat are looked up once
        held, size = [], 0
        for batch in batches:
            for part in byte_slices(batch, "text"):
                held.append(part)
                size += part.column("text").nbytes
                if size >= 3 << 20:
                    yield scores(held)
                    held, size = [], 0
        if held:
            yield scores(held)

    scored = rows.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    return scored.withColumnRenamed("id", id_col)
