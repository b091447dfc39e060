"""Exact dedup by a content sort.

Sampled splitters range-partition the rows by (first characters, SHA-256) of the normalised text, an external
sort in each partition places equals adjacent, and neighbours are compared in full.  Within equals the row to keep
comes first in the order, so a group of any size may spread over many partitions: only the first and last run
of a partition can go on elsewhere, and these two rows a partition are chained afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxquarry.llm.seams import chain_seams
from boxquarry.llm.storage import cut

#: White space that doesn't tell texts apart, as a Java pattern.
SPACE = "[\\x20\\x09-\\x0D]"


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_rows: bool = False, prefix: int = 32) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256), and ``row``.

    Texts are equal when identical after deleting ASCII white space; null counts as empty.  Of equal texts the row
    with the most code points in its original text stays, then the smallest id, null ids last; of rows that are
    alike in all this, exactly one stays.  ``row`` (with_rows) is a struct of the row's own columns, so extra columns
    with any name are safe.  Ids are whole numbers: a text that is none raises.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, "")
    row = F.struct(*[F.col(c) for c in docs.columns])
    base = docs.select(F.col(id_col).cast("long").alias("id"), norm.alias("norm"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"), *([row.alias("row")] if with_rows else []))
    base = base.withColumns({"head": F.substring("norm", 1, prefix), "sha": F.unhex(F.sha2("norm", 256))})
    ranges = ["head", "sha", F.desc("points"), F.asc_nulls_last("id")]
    dealt = base.repartitionByRange(*ranges).sortWithinPartitions("head", "sha", "norm", *ranges[2:])
    kind = dealt.drop("head", "norm").schema
    out = T.StructType([T.StructField("seam", T.BooleanType()), T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("first", T.BooleanType()), T.StructField("size", T.LongType()), T.StructField("keep", T.LongType()), *kind.fields])
    found = cut(dealt.mapInArrow(_runs, out), "exact-runs")
    chained = chain_seams(found.where("seam").select("part", "run", F.col("sha").alias("key"), "size", "keep"))
    whole = W.partitionBy("chain")
    fixed = chained.select(
        F.col("part"),
        F.col("run"),
        F.sum("size").over(whole).alias("chain_size"),
        F.first("keep").over(whole.orderBy("part", "run").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("chain_keep"),
        (F.row_number().over(whole.orderBy("part", "run")) == 1).alias("chain_first"),
    )
    # two rows for each partition of the sort at most
    rows = found.where("not seam").join(F.broadcast(fixed), ["part", "run"], "left")
    inside = F.col("chain_size").isNull()
    return rows.select(
        F.col("id").alias(id_col),
        F.when(inside, F.col("keep")).otherwise(F.col("chain_keep")).alias("keep_id"),
        F.coalesce("chain_size", "size").alias("group_size"),
        (F.col("first") & F.coalesce("chain_first", F.lit(True))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *(["row"] if with_rows else []),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: each row with its run, the run's size and its first id; then the partition's seams."""
    part, run, last, waiting, ends = TaskContext.get().partitionId(), -1, None, [], []
    kind: pa.Schema | None = None

    def batch_of(rows: pa.RecordBatch, seam: bool, runs: np.ndarray, first: np.ndarray, size: np.ndarray, keep: pa.Array) -> pa.RecordBatch:
        n = len(rows)
        lead = [pa.array([seam] * n, pa.bool_()), pa.array([part] * n, pa.int32()), pa.array(runs, pa.int64()), pa.array(first, pa.bool_()), pa.array(size, pa.int64()), keep]
        return pa.RecordBatch.from_arrays([*lead, *rows.columns], names=["seam", "part", "run", "first", "size", "keep", *rows.schema.names])

    def closed(held: list[tuple[pa.RecordBatch, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """The rows of whole runs, given with their runs' numbers."""
        if not held:
            return
        table = pa.Table.from_batches([h[0] for h in held]).combine_chunks()
        runs = np.concatenate([h[1] for h in held])
        fresh = np.r_[True, runs[1:] != runs[:-1]]
        starts = np.flatnonzero(fresh)
        place = np.cumsum(fresh) - 1
        size = np.diff(starts, append=len(runs))
        keep = table.column("id").combine_chunks().take(pa.array(starts[place]))
        rows = table.to_batches()[0]
        for at, number in ((0, runs[0]), (len(runs) - 1, runs[-1])):
            seam = batch_of(rows.slice(int(starts[place[at]]), 1), True, np.array([number]), np.array([True]), size[place[at] : place[at] + 1], keep.slice(at, 1))
            if not ends:
                ends.append(seam)
            elif number != ends[0].column("run")[0].as_py():
                ends[1:] = [seam]
        yield batch_of(rows, False, runs, fresh, size[place], keep)

    for batch in batches:
        if not len(batch):
            continue
        texts = batch.column("norm")
        fresh = np.ones(len(batch), dtype=bool)
        if len(batch) > 1:
            fresh[1:] = ~pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        fresh[0] = last is None or texts[0].as_py() != last
        last = texts[len(texts) - 1].as_py()
        runs = run + np.cumsum(fresh)
        run = int(runs[-1])
        thin = batch.select([n for n in batch.schema.names if n not in ("norm", "head")])
        kind = thin.schema
        begin = int(np.flatnonzero(fresh)[-1]) if fresh.any() else None
        if begin is None:
            waiting.append((thin, runs))
        else:
            if begin:
                waiting.append((thin.slice(0, begin), runs[:begin]))
            yield from closed(waiting)
            waiting = [(thin.slice(begin), runs[begin:])]
    yield from closed(waiting)
    yield from ends


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, in its columns."""
    return exact_groups(docs, id_col, text_col, with_rows=True).where("kept").select("row.*")
