"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquarry.llm.arrow_batches import byte_slices
from boxquarry.llm.storage import cut, free_name
from boxquarry.llm.suffix_automaton import _WORDS, SuffixAutomaton, item_words
from boxquarry.llm.text_hashing import ALNUM_WORDS, word_hashes

WINDOW = 10


class ItemIndex:
    """The automaton of one block of items, with what each state means for windows of ``window`` words."""

    def __init__(self, names: list[str], texts: list[list[bytes]], window: int, longest: int = 0):
        self.names, self.window = names, window
        self.automaton = SuffixAutomaton(texts)
        # items that are found as a whole: those without a window, and those that a limit of ``longest`` words would pass over
        short = {n: len(t) for n, t in enumerate(texts) if len(t) < max(window, longest)}
        self.least = min([window, *short.values()])
        self.short = self.automaton.marks(short)
        self.deep = self.automaton.windows(window)

    def hits(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, tuple[int, ...], bool]]:
        """(start, end, items, whether it is a whole item) of each occurrence of a window."""
        out = []
        members, short, deep, window = self.automaton.members, self.short, self.deep, self.window
        for at, tokens in self.automaton.runs(words, self.least, bounds):
            states, lengths = self.automaton.statistics(tokens)
            for k, (state, length) in enumerate(zip(states, lengths, strict=True)):
                if length >= window:
                    out.append((at + k + 1 - window, at + k + 1, members[deep[state]], False))
                for item, size in short[state]:
                    if length >= size:
                        out.append((at + k + 1 - size, at + k + 1, (item,), True))
        return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int, most_words: int, longest: int = 0) -> Iterator[ItemIndex]:
    """Indexes over consecutive items with at most ``most_words`` words together, or one item.

    Items without words are left out.  Only one block of items is on the driver at a time.
    """
    names, texts, held = [], [], 0
    for row in items.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).toLocalIterator():
        if words := item_words(row[1]):
            if names and held + len(words) > most_words:
                yield ItemIndex(names, texts, window, longest)
                names, texts, held = [], [], 0
            names.append(row[0])
            texts.append(words)
            held += len(words)
    if names:
        yield ItemIndex(names, texts, window, longest)


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, most_words: int = 500_000) -> DataFrame:
    """``docs`` with a column ``contamination``: struct(n_words, spans, items).

    spans: merged (start, end) word ranges covered by occurrences of windows, i.e. ``window`` consecutive words of an
    item, or the whole of a shorter item; items: sorted distinct ids of the items with occurring windows.
    The items are taken in blocks of at most ``most_words`` words: the driver and each broadcast hold one block,
    and the rows pass through all blocks without a shuffle.  Null and empty texts have no words and no hits, an empty items table gives
    no hits, repeated rows are each answered, null item ids and item texts are ignored, and other columns are kept.
    """
    col = free_name(docs, "contamination")
    empty = "named_struct('n_words', 0L, 'spans', cast(array() as array<struct<start:bigint,end:bigint>>), 'items', cast(array() as array<string>))"
    out = docs.withColumn(col, F.expr(empty))
    text_at, col_at = out.columns.index(text_col), len(out.columns) - 1
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def mark(part: pa.RecordBatch, index: ItemIndex | None) -> list[pa.Array]:
        words, bounds = word_hashes(part.column(text_at), ALNUM_WORDS)
        before = part.column(col_at).to_pylist()
        spans = [[(s["start"], s["end"]) for s in x["spans"]] for x in before]
        items = [set(x["items"]) for x in before]
        for row, start, end, which, _ in row_hits(index, words, bounds):
            spans[row].append((start, end))
            items[row].update(which)
        value = [{"n_words": n, "spans": [{"start": a, "end": b} for a, b in merged(s)], "items": sorted(i)} for n, s, i in zip(np.diff(bounds).tolist(), spans, items, strict=True)]
        return [*part.columns[:col_at], pa.array(value, type=kind)]

    return through_blocks(out, text_at, shared_blocks(docs.sparkSession, item_blocks(items, item_id, item_text, window, most_words)), mark)


def shared_blocks(spark: SparkSession, blocks: Iterator[ItemIndex]) -> list[Broadcast]:
    """A broadcast of each block, or one of None if there is none; the driver's Python keeps none of them."""
    return [spark.sparkContext.broadcast(b) for b in blocks] or [spark.sparkContext.broadcast(None)]


def through_blocks(frame: DataFrame, text_at: int, blocks: list[Broadcast], change) -> DataFrame:
    """All rows through ``change(rows, block)`` for each block of items."""

    def one_pass(rows: DataFrame, shared: Broadcast) -> DataFrame:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbered = batch.rename_columns([str(k) for k in range(batch.num_columns)])
                for part in byte_slices(numbered, str(text_at)):
                    yield pa.RecordBatch.from_arrays(change(part, shared.value), names=batch.schema.names)

        return rows.mapInArrow(run, rows.schema)

    for block in blocks:
        frame = one_pass(frame, block)
    return frame


def row_hits(index: ItemIndex | None, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, list[str], bool]]:
    """(row, start, end, item ids, whether it is a whole item) of each occurrence of a window, in words of the row."""
    hits = index.hits(words, bounds) if index else []
    rows = (np.searchsorted(bounds, [h[0] for h in hits], side="right") - 1).tolist() if hits else []
    for (start, end, which, whole), row in zip(hits, rows, strict=True):
        yield row, start - int(bounds[row]), end - int(bounds[row]), [index.names[i] for i in which], whole


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


def contamination_report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: (id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    found = contamination(docs.select(id_col, "text"), items).select(id_col, "contamination.*")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        id_col,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of these word ranges; each range leaves one line end."""
    raw = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in _WORDS.finditer(raw.lower())]
    out, at = [], 0
    for start, end in spans:
        out += [raw[at : words[start][0]], b"\n"]
        at = words[end - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def clean(text: str, spans: list[tuple[int, int, bool]], n_words: int, most_share: float, longest: int) -> str | None:
    """The text without its spans (start, end, whether it is a whole item) over the limits; None if it goes as a whole."""
    joined = merged([(s, e) for s, e, _ in spans])
    share = sum(e - s for s, e in joined) / n_words
    if share > most_share:
        return None
    starts = [s for s, _ in joined]
    whole = {bisect_right(starts, s) - 1 for s, _, w in spans if w}
    over = [(s, e) for k, (s, e) in enumerate(joined) if e - s >= longest or share >= 0.1 or k in whole]
    return without_spans(text, over) if over else text


def clean_through(text: str, spans: list[tuple[int, int, bool]], n_words: int, index: ItemIndex, most_share: float, longest: int) -> str | None:
    """The text cleaned and looked through again until it stays; ``index`` holds all items."""
    while spans:
        new = clean(text, spans, n_words, most_share, longest)
        if new is None or new == text:
            return new
        text = new
        words, bounds = word_hashes(pa.array([text], pa.large_string()), ALNUM_WORDS)
        n_words, spans = len(words), [(s, e, w) for _, s, e, _, w in row_hits(index, words, bounds)]
    return text


def remove_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, most_share: float = 0.5, longest: int = WINDOW, most_words: int = 500_000) -> DataFrame:
    """``docs`` without contaminated passages, in the columns of ``docs``.

    Spans of ``longest`` words or more and spans that hold a whole item of any length go from the text, and so do all
    spans of a text in which they cover a tenth or more; a row whose spans cover over ``most_share`` of its words goes as
    a whole.  Spans of all blocks of items are gathered before the limits decide.  A text that changed is looked
    through again, as taking out words may join others.  Rows without hits come back as they were, null and empty texts
    too; ``length_col``, a long column if the table has it, is the new number of characters of changed texts.
    """
    names = docs.columns
    text_at = names.index(text_col)
    length_at = names.index(length_col) if length_col in names else None
    blocks = shared_blocks(docs.sparkSession, item_blocks(items, item_id, item_text, window, most_words, longest))

    def found_in(part: pa.RecordBatch, index: ItemIndex | None) -> tuple[dict[int, list[tuple[int, int, bool]]], np.ndarray]:
        words, bounds = word_hashes(part.column(text_at), ALNUM_WORDS)
        spans: dict[int, list[tuple[int, int, bool]]] = {}
        for row, start, end, _, whole in row_hits(index, words, bounds):
            spans.setdefault(row, []).append((start, end, whole))
        return spans, np.diff(bounds)

    def replaced(part: pa.RecordBatch, texts: dict[int, str | None]) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
        """The columns of the rows kept, which rows are kept, and which have a new text; texts: None for a row that goes."""
        columns, keep, changed = list(part.columns[: len(names)]), np.ones(len(part), dtype=bool), np.zeros(len(part), dtype=bool)
        if texts:
            new, lengths = columns[text_at].to_pylist(), columns[length_at].to_pylist() if length_at is not None else None
            for row, text in texts.items():
                keep[row] = text is not None
                if text is not None and text != new[row]:
                    changed[row], new[row] = True, text
                    if lengths is not None:
                        lengths[row] = len(text)
            columns[text_at] = pa.array(new, type=columns[text_at].type)
            if lengths is not None:
                columns[length_at] = pa.array(lengths, type=columns[length_at].type)
        return [c.filter(pa.array(keep)) for c in columns], keep, changed

    if len(blocks) == 1:

        def change(part: pa.RecordBatch, index: ItemIndex | None) -> list[pa.Array]:
            spans, sizes = found_in(part, index)
            texts = {row: clean_through(part.column(text_at)[row].as_py(), found, int(sizes[row]), index, most_share, longest) for row, found in spans.items()}
            return replaced(part, texts)[0]

        return through_blocks(docs, text_at, blocks, change)

    col = free_name(docs, "contamination")
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("whole", pa.bool_())])))])

    def mark(part: pa.RecordBatch, index: ItemIndex | None) -> list[pa.Array]:
        spans, sizes = found_in(part, index)
        before = part.column(len(names)).to_pylist()
        value = [{"n_words": n, "spans": x["spans"] + [{"start": s, "end": e, "whole": w} for s, e, w in spans.get(k, [])]} for k, (n, x) in enumerate(zip(sizes.tolist(), before, strict=True))]
        return [*part.columns[: len(names)], pa.array(value, type=kind)]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(len(names)).to_pylist()
            texts = {k: clean(batch.column(text_at)[k].as_py(), [(s["start"], s["end"], s["whole"]) for s in m["spans"]], m["n_words"], most_share, longest) for k, m in enumerate(marks) if m["spans"]}
            columns, keep, changed = replaced(batch, texts)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(changed[keep])], names=batch.schema.names)

    done, todo = None, docs
    while True:
        marked = todo.withColumn(col, F.expr("named_struct('n_words', 0L, 'spans', cast(array() as array<struct<start:bigint,end:bigint,whole:boolean>>))"))
        marked = through_blocks(marked, text_at, blocks, mark)
        # written, as the rows that changed go through all blocks once more
        out = cut(marked.mapInArrow(apply, docs.withColumn(col, F.lit(False)).schema), "decontaminated")
        same, todo = out.where(~F.col(col)).drop(col), out.where(col).drop(col)
        done = same if done is None else done.unionByName(same)
        if todo.isEmpty():
            return done
