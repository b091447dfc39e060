"""Fill-in-middle by a parallel scan of a finite automaton.

The automaton reads a text's bytes and knows two things: whether it stands inside a word, and how much of a marker it has
just read.  A chunk of a text is a function from the state before it to the state after it, with the number of tokens that end in it
for each state before.  Such functions compose associatively, so the chunks of a giant text are read by different
tasks, their small functions are composed, and each chunk then looks for the cuts that fall into it by itself.
A text of one chunk needs no composing and is cut where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxquarry.llm.arrow_batches import byte_slices
from boxquarry.llm.storage import cut
from boxquarry.llm.text_hashing import SPACE_WORDS, utf8_buffers

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: States: 4 * (inside a word) + marker, of which 0 is none, 1 after "<", 2 after "<P", "<S" or "<M", 3 once one was read in full.
STATES, IN_WORD, FOUND = 8, 4, 3
_NAMES = np.zeros(256, dtype=bool)
_NAMES[list(b"PSM")] = True


def _token_ends(inside: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of bytes of white space that come right after a word within the same chunk."""
    ends = np.zeros(len(inside), dtype=bool)
    ends[1:] = inside[:-1] & ~inside[1:]
    ends[starts[starts < len(ends)]] = False
    return ends


def chunk_functions(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk and each state before it: the state after it, and the number of tokens that end in it.

    A token ends where white space follows a word; the text's last token, which ends with the text, is not counted.
    """
    lo, hi = bounds[:-1], bounds[1:]
    size = hi - lo
    after = np.tile(np.arange(STATES, dtype=np.int8), (len(lo), 1))
    counts = np.zeros((len(lo), STATES), dtype=np.int64)
    some = np.flatnonzero(size)
    if not len(some):
        return after, counts
    inside = SPACE_WORDS[data]
    lo, hi, size = lo[some], hi[some], size[some]
    upto = np.append(0, np.cumsum(_token_ends(inside, lo)))
    inner = upto[hi] - upto[lo]
    first, last = data[lo], data[hi - 1]
    marks = np.flatnonzero((data[:-2] == 0x3C) & _NAMES[data[1:-1]] & (data[2:] == 0x3E)) if len(data) > 2 else np.zeros(0, dtype=np.int64)
    owner = np.searchsorted(hi, marks, side="right")
    found = np.zeros(len(lo), dtype=bool)
    found[owner[(marks >= lo[owner]) & (marks + 3 <= hi[owner])]] = True
    tail = np.where(last == 0x3C, 1, np.where((size > 1) & (data[np.maximum(hi - 2, 0)] == 0x3C) & _NAMES[last], 2, 0))
    second = data[np.minimum(lo + 1, len(data) - 1)]
    after_less = np.where(_NAMES[first] & (size > 1) & (second == 0x3E), FOUND, np.where(_NAMES[first] & (size == 1), 2, tail))
    after_name = np.where(first == 0x3E, FOUND, tail)
    marker = np.stack([tail, after_less, after_name, np.full(len(lo), FOUND)], axis=1)
    marker[found] = FOUND
    word = IN_WORD * inside[hi - 1]
    after[some] = np.concatenate([marker, marker], axis=1) + word[:, None]
    counts[some] = inner[:, None]
    counts[some, IN_WORD:] += (~inside[lo])[:, None]
    return after, counts


def compose_all(after: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row k: the functions of chunks 0 to k in one, by pairs, pairs of pairs and so on."""
    step = 1
    while step < len(after):
        way = after[:-step].astype(np.int64)
        later, more = np.take_along_axis(after[step:], way, 1), counts[:-step] + np.take_along_axis(counts[step:], way, 1)
        after, counts = np.concatenate([after[:step], later]), np.concatenate([counts[:step], more])
        step *= 2
    return after, counts


def find_cuts(data: np.ndarray, bounds: np.ndarray, entry: np.ndarray, before: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where in ``data`` the ``wanted`` number of tokens of a chunk's text have ended: its chunk's start if they end before it, its end if after.

    ``entry``: states before the chunks; ``before``: tokens that end before them.
    """
    lo, hi = bounds[:-1], bounds[1:]
    inside = SPACE_WORDS[data]
    ends = _token_ends(inside, lo)
    leads = lo[(entry >= IN_WORD) & (hi > lo)]
    ends[leads] = ~inside[leads]
    places = np.flatnonzero(ends)
    base = np.searchsorted(places, lo)
    number = wanted - before
    have = np.searchsorted(places, hi) - base
    at = np.append(places, 0)[np.clip(base + number - 1, 0, len(places))]
    return np.where(number <= 0, lo, np.where(number > have, hi, at))


def _points(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Code points in each stretch."""
    upto = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    return upto[hi] - upto[lo]


def _parts(data: np.ndarray, *bounds: np.ndarray) -> list[pa.Array]:
    """Strings of the stretches between each bound and the next one."""
    raw = data.tobytes()
    return [pa.array([raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()).cast(pa.string()) for lo, hi in zip(bounds, bounds[1:], strict=False)]


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


_SPLIT = ["prefix", "middle", "suffix", "prefix_chars", "middle_chars"]
_SPLIT_TYPES = "prefix string, middle string, suffix string, prefix_chars long, middle_chars long"


def _split(part: pa.RecordBatch, entry: np.ndarray, before: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[pa.Array]:
    data, bounds = utf8_buffers(part.column("text"))
    lo, hi = bounds[:-1], bounds[1:]
    a, b = (find_cuts(data, bounds, entry, before, wanted) for wanted in (one, two))
    return [*_parts(data, lo, a, b, hi), pa.array(_points(data, lo, a)), pa.array(_points(data, a, b))]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one chunk: (id, n, found, and the parts)."""
    for batch in batches:
        for part in byte_slices(batch, "text"):
            data, bounds = utf8_buffers(part.column("text"))
            after, counts = chunk_functions(data, bounds)
            n = counts[:, 0] + (np.diff(bounds) > 0)
            one, two = (_column(part, h) % (n + 1) for h in ("h1", "h2"))
            zero = np.zeros(len(n), dtype=np.int64)
            split = _split(part, zero, zero, np.minimum(one, two), np.maximum(one, two))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), pa.array(after[:, 0] % IN_WORD == FOUND), *split], names=["id", "n", "found", *_SPLIT])


def _chunks(most: int):
    """Cuts each text into chunks of at most ``most`` bytes, between characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", 1):
                data, _ = utf8_buffers(part.column("text"))
                edges = [0]
                while edges[-1] < len(data):
                    at = min(edges[-1] + most, len(data))
                    while at < len(data) and data[at] & 0xC0 == 0x80:
                        at -= 1
                    edges.append(at)
                for first in range(0, len(edges) - 1, 64):
                    own = edges[first : first + 65]
                    texts = _parts(data, np.array(own[:-1]), np.array(own[1:]))[0]
                    k = len(texts)
                    same = pa.array(np.zeros(k, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([part.column("key").take(same), part.column("id").take(same), pa.array(np.arange(first, first + k, dtype=np.int32)), texts], names=["key", "id", "chunk", "text"])

    return run


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The function of each chunk."""
    for batch in batches:
        for part in byte_slices(batch, "text"):
            after, counts = chunk_functions(*utf8_buffers(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("chunk"), pa.array(list(after), pa.list_(pa.int8())), pa.array(list(counts), pa.list_(pa.int64()))], names=["key", "chunk", "after", "counts"])


def _resolve(rows: pa.Table) -> pa.Table:
    """Of the functions of one text's chunks: each chunk's entry state, the tokens that end before it, and what holds for the text.

    A text's row is bounded by Spark (2 GB), and with it the number of its chunks.
    """
    rows = rows.sort_by("chunk").combine_chunks()
    after = np.array(rows["after"].to_pylist(), dtype=np.int8).reshape(-1, STATES)
    after, counts = compose_all(after, np.array(rows["counts"].to_pylist(), dtype=np.int64).reshape(-1, STATES))
    k = len(after)
    entry, before = np.append(0, after[:-1, 0]).astype(np.int32), np.append(0, counts[:-1, 0])
    n, found = counts[-1, 0] + 1, bool(after[-1, 0] % IN_WORD == FOUND)
    return pa.table([rows["key"], rows["chunk"], pa.array(entry), pa.array(before), pa.array(np.full(k, n)), pa.array([found] * k)], names=["key", "chunk", "entry", "before", "n", "found"])


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's share of its text's three parts."""
    for batch in batches:
        for part in byte_slices(batch, "text"):
            n = _column(part, "n")
            one, two = (_column(part, h) % (n + 1) for h in ("h1", "h2"))
            split = _split(part, _column(part, "entry"), _column(part, "before"), np.minimum(one, two), np.maximum(one, two))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "id", "chunk", "n", "found")), *split], names=["key", "id", "chunk", "n", "found", *_SPLIT])


def _draw(seed: int, key: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits of the SHA-256 of seed and id, as a number; a null id is the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def _giant_parts(docs: DataFrame, chunk: int, seed: int) -> DataFrame:
    """(id, n, found, and the parts) of texts of several chunks, which are dealt out to all tasks."""
    kind = docs.schema["id"].dataType.simpleString()
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "id", "text")
    # a chunk's place in a range of them is its task's: many chunks of one text are no hot key
    chunks = cut(keyed.mapInArrow(_chunks(chunk), f"key long, id {kind}, chunk int, text string").repartition("key", "chunk"), "chunks")
    functions = chunks.select("key", "chunk", "text").mapInArrow(_functions, "key long, chunk int, after array<tinyint>, counts array<long>")
    resolved = functions.groupBy("key").applyInArrow(_resolve, "key long, chunk int, entry int, before long, n long, found boolean")
    seen = chunks.join(resolved, ["key", "chunk"]).select("*", _draw(seed, F.col("id"), 1).alias("h1"), _draw(seed, F.col("id"), 2).alias("h2"))
    shares = seen.mapInArrow(_select, f"key long, id {kind}, chunk int, n long, found boolean, {_SPLIT_TYPES}")
    listed = F.array_sort(F.collect_list(F.struct("chunk", "prefix", "middle", "suffix")))
    joined = shares.groupBy("key").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.first("found").alias("found"), listed.alias("all"), F.sum("prefix_chars").alias("prefix_chars"), F.sum("middle_chars").alias("middle_chars"))
    text = lambda name: F.array_join(F.transform("all", lambda x: x[name]), "").alias(name)
    return joined.select("id", "n", "found", text("prefix"), text("middle"), text("suffix"), "prefix_chars", "middle_chars")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 50, suffix_first: int = 80, seed: int = 42, chunk: int = 1 << 16) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n, form, prefix_chars, middle_chars, output).

    A text of n tokens (white space and then a word; last, white space alone) is cut after two numbers of tokens that a hash of the id draws.
    ``rate`` of a hundred texts change form, of these ``suffix_first`` of a hundred to ``<S>``suffix``<P>``prefix``<M>``middle ("spm"), the others to
    ``<P>``prefix``<S>``suffix``<M>``middle ("psm").  Empty and null texts (n is 0) and those that hold a marker stay as they are ("plain",
    without numbers of characters).  Texts of more than ``chunk`` bytes are read by several tasks.  Repeated rows and ids give a row
    each, alike for alike ids and texts; a null id draws as an empty one; extra columns are ignored; an empty table has no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    draw = lambda k: _draw(seed, F.col("id"), k)
    small = rows.where(F.octet_length("text") <= chunk).select("id", "text", draw(1).alias("h1"), draw(2).alias("h2"))
    small = small.mapInArrow(_whole, f"id {kind}, n long, found boolean, {_SPLIT_TYPES}")
    parts = small.unionByName(_giant_parts(rows.where(F.octet_length("text") > chunk), chunk, seed))
    plain = (F.col("n") == 0) | F.col("found") | (draw(3) % 100 >= rate)
    formed = parts.withColumn("form", F.when(plain, "plain").when(draw(4) % 100 < suffix_first, "spm").otherwise("psm"))
    mark = {"spm": F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"), "psm": F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")}
    output = F.when(F.col("form") == "spm", mark["spm"]).when(F.col("form") == "psm", mark["psm"]).otherwise(F.concat("prefix", "middle", "suffix"))
    chars = lambda name: F.when(F.col("form") != "plain", F.col(name)).alias(name)
    return formed.select(F.col("id").alias(id_col), "n", "form", chars("prefix_chars"), chars("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` has given this output and form."""
    middle = F.substring_index(output, MIDDLE, -1)
    before = lambda text, mark: F.substring_index(text, mark, 1)
    rest = lambda text: F.substr(text, F.lit(len(PREFIX) + 1))
    psm = F.concat(rest(before(output, SUFFIX)), middle, before(F.substring_index(output, SUFFIX, -1), MIDDLE))
    spm = F.concat(before(F.substring_index(output, PREFIX, -1), MIDDLE), middle, rest(before(output, PREFIX)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
