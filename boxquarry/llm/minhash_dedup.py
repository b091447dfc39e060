"""MinHash near-dedup of documents: shingles of five words, links of Jaccard 0.85 or more, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxquarry.llm.arrow_batches import byte_slices
from boxquarry.llm.components import connected_components
from boxquarry.llm.near_dup import Minima, bucket_links, similar_components
from boxquarry.llm.storage import cut
from boxquarry.llm.text_hashing import SPACE_WORDS, mix, shingle_hashes, word_hashes

WIDTH, SHARE, BANDS, ROWS = 5, 85, 20, 5


def document_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, bounds = word_hashes(texts, SPACE_WORDS)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        found = np.sort(shingle_hashes(words[lo:hi], width))
        if len(found):
            found = found[np.r_[True, found[1:] != found[:-1]]]
        out.append(found)
    return out


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits that tell sets apart: two sums of independently mixed members, with the size."""
    if not len(hashes):
        return b""
    one = int(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
    two = int(mix(hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(hashes))).sum(dtype=np.uint64))
    return one.to_bytes(8, "little") + two.to_bytes(8, "little")


def sketch(docs: DataFrame, id_col: str, text_col: str, minima: Minima, width: int = WIDTH) -> DataFrame:
    """(node, n_shingles, digest, keys) of each row; digest is null for rows without words."""
    schema = pa.schema([("node", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                sets = document_sets(part.column("text"), width)
                keys = minima.keys(np.stack([minima.signature(s) for s in sets]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) or None for s in sets], pa.binary()), pa.array([k if len(s) else None for k, s in zip(keys, sets, strict=True)], pa.list_(pa.int64()))], schema=schema
                )

    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "node long, n_shingles long, digest binary, keys array<long>")


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH, block: int = 256) -> DataFrame:
    """One row for each row of ``docs``: (id, n_shingles, component_id, kept).

    Two documents are linked if 100 * intersection >= share * union of their sets of distinct shingles of
    ``width`` words (A-Z lower-cased, split at ASCII white space); component_id is the smallest id reachable.
    A text with fewer words is one shingle.  Null and empty texts have no shingles and stand alone.
    Documents with one and the same set are one node.  Rows with a null id stand alone, with a null component
    and kept; repeated ids with one text are one document and give equal rows.  Extra columns are ignored.  Ids are whole
    numbers: a text that is none raises.
    A pair of Jaccard 0.85 is overlooked with a chance of (1 - 0.85**rows)**bands = 8e-6.
    """
    minima = Minima(bands, rows)
    drawn = cut(sketch(docs, id_col, text_col, minima, width), "minhash-sketch")
    classes = drawn.where("digest is not null and node is not null").groupBy("digest").agg(F.min("node").alias("class"))
    # of rows with one set, only the first goes on; the keys are read again for those alone
    heads = drawn.where("digest is not null").join(classes, (drawn["digest"] == classes["digest"]) & (drawn["node"] == classes["class"])).select("node", "keys").dropDuplicates(["node"])
    keyed = heads.select(F.explode("keys").alias("key"), "node")
    contents = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("content")).where("node is not null and content is not null")
    groups = connected_components(bucket_links(keyed, "minhash"), "minhash-group").withColumnRenamed("component", "unit")
    found = similar_components(cut(groups, "minhash-groups"), contents, lambda texts: document_sets(texts, width), share, "minhash", block)
    named = cut(classes.join(found, classes["class"] == found["node"], "left").select("digest", F.coalesce("component", "class").alias("component_id")), "minhash-classes")
    out = drawn.join(named, "digest", "left").select("node", "n_shingles", F.when(F.col("node").isNotNull(), F.coalesce("component_id", "node")).alias("component_id"))
    return out.select(F.col("node").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("node") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, in its columns; of rows with one id all go or stay."""
    found = minhash_components(docs, id_col, text_col, **options).where("not kept").select(F.col(id_col).alias("gone")).distinct()
    # a merge join at every size: the dropped ids grow with the input
    return docs.join(found.hint("merge"), F.col(id_col).cast("long") == F.col("gone"), "left_anti")
