"""The common part of near-duplicate search over sets of 64-bit shingle hashes.

1. Sketch: many hash minima of each set, in bands; a band's minima give one bucket key.
2. Units: sets of nodes that may be similar.  Two nodes that share a bucket are in one unit at least.
   ``bucket_links`` makes links whose components are units (op5); ``bucket_units`` makes units inside the buckets,
   of nodes whose bit sketches are alike (op2).  Both spread a hot key over many partitions.
3. Confirmation: exact intersections of full sets decide.  A unit is cut into blocks of bounded size.  The first block
   meets all blocks; then the nodes outside the largest component found so far meet all blocks.  So a large group of
   true copies costs time in proportion to its size, and no pair that could join two components is left out.
4. Components of the true links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxquarry.llm.arrow_batches import byte_slices
from boxquarry.llm.components import connected_components
from boxquarry.llm.seams import chain_seams
from boxquarry.llm.storage import cut, discard
from boxquarry.llm.text_hashing import mix


class Minima:
    """``bands * rows`` hash minima; universal functions a*x+b on 64-bit integers with odd a."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = draw.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.uint64(2**64 - 1))
        for k in range(0, len(hashes), 2048):
            np.minimum(least, (np.multiply.outer(self.a, hashes[k : k + 2048]) + self.b[:, None]).min(axis=1), out=least)
        return least

    def signatures(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Signatures of many sets at once, from 32-bit hashes one set after another; members may repeat, no set is empty."""
        small, a = hashes if hashes.dtype == np.uint32 else (hashes >> np.uint64(32)).astype(np.uint32), self.a.astype(np.uint32) | np.uint32(1)
        out, times = np.empty((len(a), len(starts)), dtype=np.uint32), np.empty_like(small)
        for k in range(len(a)):
            np.multiply(small, a[k], out=times)
            np.minimum.reduceat(times, starts, out=out[k])
        return np.ascontiguousarray(out.T)

    def sketches(self, signatures: np.ndarray) -> np.ndarray:
        """64 bits of each signature, one of each of its last 64 minima: bits of two sets agree with a chance of (1 + Jaccard) / 2."""
        bits = np.zeros((len(signatures), 64), dtype=np.uint8)
        last = np.ascontiguousarray(signatures[:, -64:], dtype=np.uint32)
        bits[:, : last.shape[1]] = last * np.uint32(0x85EBCA6B) >> np.uint32(31)
        return np.packbits(bits, axis=1).view(np.uint64).reshape(-1)

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """Bucket keys of each signature, one for each band, as signed 64-bit integers."""
        parts = signatures.reshape(len(signatures), self.bands, self.rows)
        out = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), parts.shape[:2]).copy()
        for k in range(self.rows):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
        return out.view(np.int64)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: a link from each node to the first with its key, and the partition's seams."""
    part, key, hub, run, head = TaskContext.get().partitionId(), None, None, 0, None

    def rows(seam: bool, **x: list) -> pa.RecordBatch:
        n = len(x["a"])
        x = {"seam": [seam] * n, "part": [part] * n, "run": [0] * n, "key": [0] * n, "b": [0] * n} | x
        return pa.RecordBatch.from_pydict({k: x[k] for k in ("seam", "part", "run", "key", "a", "b")}, schema=_STAR)

    for batch in batches:
        keys, nodes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node"))
        if not len(keys):
            continue
        fresh = np.empty(len(keys), dtype=bool)
        fresh[0] = key is None or keys[0] != key
        fresh[1:] = keys[1:] != keys[:-1]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), -1))
        hubs = np.where(first >= 0, nodes[first], 0 if hub is None else hub)
        if head is None:
            head = (int(keys[0]), int(nodes[0]))
        linked = ~fresh & (hubs != nodes)
        run, key, hub = run + int(fresh.sum()), int(keys[-1]), int(hubs[-1])
        if linked.any():
            yield rows(False, a=nodes[linked], b=hubs[linked])
    if head is not None:
        ends = [(1, *head)] + ([(run, key, hub)] if run > 1 else [])
        yield rows(True, run=[e[0] for e in ends], key=[e[1] for e in ends], a=[e[2] for e in ends])


_STAR = pa.schema([("seam", pa.bool_()), ("part", pa.int32()), ("run", pa.int64()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_STAR_SQL = "seam boolean, part int, run long, key long, a long, b long"


class Splits:
    """Bounds of ranges of (key, node) pairs, about equally full, from a sample of pairs."""

    def __init__(self, keys: np.ndarray, nodes: np.ndarray, parts: int):
        order = np.lexsort((nodes, keys))
        at = order[np.arange(1, parts) * len(order) // parts] if len(order) else order
        self.keys, self.nodes = keys[at], nodes[at]
        # keys by their first 12 bits: the range of all keys of a cell, or -1 where a bound lies in it
        lowest = np.arange(-2048, 2048, dtype=np.int64) << 52
        below, upto = np.searchsorted(self.keys, lowest, "left"), np.searchsorted(self.keys, lowest + ((1 << 52) - 1), "right")
        self.cells = np.where(below == upto, below, -1).astype(np.int32)

    def part(self, keys: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The range of each pair: how many bounds are smaller."""
        out = self.cells[(keys >> 52) + 2048]
        hard = np.flatnonzero(out < 0)
        out[hard] = self._among(keys[hard], nodes[hard])
        return out

    def _among(self, keys: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        first = np.searchsorted(self.keys, keys, "left")
        out = first.astype(np.int32)
        if len(self.keys):
            on = self.keys[np.minimum(first, len(self.keys) - 1)] == keys
            # a key that is a bound itself is split by nodes
            for lo in np.unique(first[on]).tolist():
                hi, same = int(np.searchsorted(self.keys, self.keys[lo], "right")), on & (first == lo)
                out[same] += np.searchsorted(self.nodes[lo:hi], nodes[same], "left").astype(np.int32)
        return out

    def shared(self, part: int) -> np.ndarray:
        """Keys of a range that other ranges may hold too."""
        return np.unique(self.keys[max(0, part - 1) : part + 1])


#: Bytes of text that are hashed at once: work arrays of this size stay in a core's cache.
AT_ONCE = 1 << 17
_PACKED = "part int, base long, places binary, keys binary, sketches binary"
_UNIT = pa.schema([("unit", pa.int64()), ("seq", pa.int64())])


def packed_keys(contents: DataFrame, total: int, sketch_of, bands: int) -> tuple[DataFrame, Splits]:
    """Bucket keys and sketches of ``contents`` (seq, content), packed: a row for each range of keys and some thousands of sets.

    An entry has 14 bytes: the low half of the key, the sketch, and the set's place after ``base``.  ``sketch_of`` makes (keys, sketches)
    of an Arrow array.  Keys of a sample of rows, about 100 pairs a range or 2000 rows, give the bounds; ``total`` is about the number of rows.
    """
    ranges = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(2000, 100 * ranges // bands)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in byte_slices(batch, "content", AT_ONCE):
                keys = sketch_of(piece.column("content"))[0]
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(piece.column("seq").to_numpy(), bands))], names=["key", "seq"])

    sample = contents.sample(min(1.0, wanted / max(total, 1)), seed=11).mapInArrow(plain, "key long, seq long").toArrow()
    splits = Splits(*(sample.column(c).to_numpy() for c in ("key", "seq")), ranges)

    def pack(seqs: np.ndarray, keys: np.ndarray, sketches: np.ndarray) -> pa.RecordBatch:
        base = int(seqs.min())
        rows = np.repeat(np.arange(len(seqs)), bands)
        part = splits.part(keys.reshape(-1), seqs[rows])
        order = np.argsort(part.astype(np.uint16) if ranges < 1 << 16 else part, kind="stable")
        rows, sizes = rows[order], np.bincount(part, minlength=ranges)
        places, low, bits = (seqs - base).astype(np.uint16)[rows], keys.reshape(-1)[order].astype(np.uint32), sketches[rows]
        used = np.flatnonzero(sizes)
        ends = np.cumsum(sizes)[used]
        cuts = list(zip((ends - sizes[used]).tolist(), ends.tolist(), strict=True))
        blobs = [pa.array([x[lo:hi].tobytes() for lo, hi in cuts], pa.binary()) for x in (places, low, bits)]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), base)), *blobs], names=["part", "base", "places", "keys", "sketches"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        least, most = 0, -1
        for batch in batches:
            for piece in byte_slices(batch, "content", AT_ONCE):
                # a piece is hashed whole, whatever its numbers are; only those within 2**15 of one another are packed into one row
                seqs, (keys, sketches) = piece.column("seq").to_numpy(), sketch_of(piece.column("content"))
                order = np.argsort(seqs, kind="stable")
                for some in np.split(order, np.flatnonzero(np.diff(seqs[order] >> 14)) + 1):
                    lo, hi = int(seqs[some[0]]), int(seqs[some[-1]])
                    if held and max(most, hi) - min(least, lo) >= 1 << 15:
                        yield pack(*(np.concatenate(x) for x in zip(*held, strict=True)))
                        held = []
                    least, most = (min(least, lo), max(most, hi)) if held else (lo, hi)
                    held.append((seqs[some], keys[some], sketches[some]))
        if held:
            yield pack(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return contents.mapInArrow(run, _PACKED), splits


def _alike(runs: np.ndarray, sketches: np.ndarray, apart: int) -> np.ndarray:
    """A label for each entry, equal for those of one run that a chain of sketches with at most ``apart`` different bits connects."""
    first, second, d = [], [], 1
    here = np.arange(len(runs))
    while len(here := here[here + d < len(runs)]) and len(here := here[runs[here] == runs[here + d]]):
        near = here[np.bitwise_count(sketches[here] ^ sketches[here + d]) <= apart]
        first.append(near)
        second.append(near + d)
        d += 1
    label = np.arange(len(runs))
    if first:
        a, b = np.concatenate(first), np.concatenate(second)
        while True:
            least = np.minimum(label[a], label[b])
            if (label[a] == least).all() and (label[b] == least).all():
                break
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            label = label[label]
    return label


def bucket_units(packed: DataFrame, splits: Splits, apart: int, large: int = 4096) -> DataFrame:
    """(unit, seq): within each bucket, units of two or more sets that a chain of alike sketches connects.

    A unit is known by its first member, so the parts of one cluster that share buckets are mostly one.  A bucket that goes on in other ranges,
    or of more than ``large`` sets, is one unit as a whole, known by its key.  A task holds one range of entries.
    """
    spark = packed.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, keys, bits, part = [], [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"]
                places.append(np.frombuffer(row["places"], dtype=np.uint16) + np.int64(row["base"]))
                keys.append(np.frombuffer(row["keys"], dtype=np.uint32))
                bits.append(np.frombuffer(row["sketches"], dtype=np.uint64))
        if not keys:
            return
        seqs, keys, bits = (np.concatenate(x) for x in (places, keys, bits))
        order = np.argsort(keys)
        keys = keys[order]
        same = np.r_[False, keys[1:] == keys[:-1]]
        many = same | np.r_[same[1:], False]
        keys, order = keys[many], order[many]
        seqs, bits = seqs[order], bits[order]
        begins = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, dtype=bool)
        runs = np.cumsum(begins) - 1
        sizes = np.bincount(runs) if len(runs) else np.zeros(0, dtype=np.int64)
        shared = splits.shared(part)
        whole = (sizes > large)[runs] | np.isin(keys, shared.astype(np.uint32))
        names = {int(np.uint32(k & 0xFFFFFFFF)): int(k) for k in shared.tolist()}
        for k in np.unique(keys[whole]).tolist():
            at = np.flatnonzero(keys == k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), -1 - abs(names.get(k, part << 32 | k)) // 2)), pa.array(seqs[at])], schema=_UNIT)
        seqs, bits, runs = seqs[~whole], bits[~whole], runs[~whole]
        label = _alike(runs, bits, apart)
        order = np.argsort(label, kind="stable")
        label, seqs = label[order], seqs[order]
        if len(label):
            starts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
            counts = np.diff(starts, append=len(label))
            keep = np.repeat(counts > 1, counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.minimum.reduceat(seqs, starts), counts)[keep]), pa.array(seqs[keep])], schema=_UNIT)

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartitionById(ranges, F.col("part")).mapInArrow(run, "unit long, seq long").distinct()


def bucket_links(keyed: DataFrame, name: str) -> DataFrame:
    """Links (a, b) that connect all nodes with a key in common; ``keyed`` has key and node, both long."""
    dealt = keyed.select("key", "node").repartitionByRange("key", "node")
    # one column, so that Spark can sort by radix; the nodes of one key may come in any order
    found = cut(dealt.sortWithinPartitions("key").mapInArrow(_stars, _STAR_SQL), f"{name}-stars")
    chained = chain_seams(found.where("seam").select("part", "run", "key", F.col("a")))
    hub = chained.groupBy("chain").agg(F.min_by("a", F.struct("part", "run")).alias("b"))
    across = chained.join(hub, "chain").where("a != b").select("a", "b")
    return found.where("not seam").select("a", "b").unionByName(across)


def _few_links(nodes: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, side: np.ndarray | None, share: int, of: int) -> np.ndarray:
    """``true_links`` of a few sets, pair by pair; a pair that is connected already isn't compared."""
    group, kept, sizes = list(range(len(sets))), [], sizes.tolist()
    for j in range(1, len(sets)):
        for i in range(j):
            small, large = min(sizes[i], sizes[j]), max(sizes[i], sizes[j])
            if group[i] == group[j] or of * small < share * large or not small or (side is not None and side[i] == side[j]):
                continue
            at = np.searchsorted(sets[i], sets[j])
            at[at == sizes[i]] = 0
            both = int(np.count_nonzero(sets[i][at] == sets[j]))
            if of * both >= share * (small + large - both):
                kept.append((nodes[i], nodes[j]))
                group = [group[i] if x == group[j] else x for x in group]
    return np.array(kept, dtype=np.int64).reshape(-1, 2)


def true_links(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, share: int, of: int = 100) -> np.ndarray:
    """Rows (a, b) of a spanning forest of all pairs with of * intersection >= share * union.

    With ``side``, only pairs between its two sides count.  Columns of the set matrix that one node alone has
    can't matter; those of two nodes are counted as pairs, the others by blockwise matrix products.
    """
    n = len(sets)
    if n < 2:
        return np.zeros((0, 2), dtype=np.int64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if n <= 8:
        return _few_links(nodes, sets, sizes, side, share, of)
    owner = np.repeat(np.arange(n), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, dtype=np.int64)
    counts = np.diff(starts, append=len(values))
    two = starts[counts == 2]
    common = np.zeros(n * n, dtype=np.int64)
    np.add.at(common, owner[two] * n + owner[two + 1], 1)
    common = common.reshape(n, n)
    common += common.T
    many = counts > 2
    column = np.repeat(np.where(many, np.cumsum(many) - 1, -1), counts)
    keep = column >= 0
    owner, column = owner[keep], column[keep]
    width = min(2048, max(1, int(many.sum())))
    if side is not None:
        one, two = np.flatnonzero(side == side[0]), np.flatnonzero(side != side[0])
    for at in range(0, int(many.sum()), width):
        lo, hi = np.searchsorted(column, (at, at + width))
        block = np.zeros((n, width), dtype=np.float32)
        block[owner[lo:hi], column[lo:hi] - at] = 1
        if side is None:
            common += np.rint(block @ block.T).astype(np.int64)
        else:
            across = np.rint(block[one] @ block[two].T).astype(np.int64)
            common[np.ix_(one, two)] += across
            common[np.ix_(two, one)] += across.T
    hit = of * common >= share * (sizes[:, None] + sizes[None, :] - common)
    hit &= (sizes > 0)[:, None] & (sizes > 0)[None, :]
    if side is not None:
        hit &= side[:, None] != side[None, :]
    first, second = np.nonzero(np.triu(hit, 1))
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, j in zip(first.tolist(), second.tolist(), strict=True):
        if (p := root(i)) != (q := root(j)):
            parent[max(p, q)] = min(p, q)
            kept.append((nodes[i], nodes[j]))
    return np.array(kept, dtype=np.int64).reshape(-1, 2)


def _links_batch(links: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(links[:, 1], pa.int64()), pa.array(links[:, 0], pa.int64())], names=["a", "b"])


def _confirmed(held: DataFrame, hashes_of, share: int) -> DataFrame:
    """Links (a, b) of true pairs in each meeting (unit, lo, hi) of ``held`` (with side, node, content): a spanning forest of them.

    Where lo and hi differ or lo is negative, only pairs of different sides count.
    """
    meetings = ["unit", "lo", "hi"]

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by meeting; those of one meeting, which is bounded by two blocks, are held until it is whole."""
        key, held_nodes, held_sides, held_sets = None, [], [], []

        def decide() -> np.ndarray:
            if len(held_sets) < 2:
                return np.zeros((0, 2), dtype=np.int64)
            return true_links(np.array(held_nodes), held_sets, None if key[1] == key[2] else np.array(held_sides), share)

        for batch in batches:
            for part in byte_slices(batch, "content", AT_ONCE):
                keys = np.stack([part.column(c).to_numpy() for c in meetings], axis=1)
                nodes, sides, sets = part.column("node").to_pylist(), part.column("side").to_pylist(), hashes_of(part.column("content"))
                starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]).tolist()
                out = []
                for lo, hi in zip(starts, [*starts[1:], len(keys)], strict=True):
                    now = tuple(keys[lo].tolist())
                    if now != key:
                        out.append(decide())
                        key, held_nodes, held_sides, held_sets = now, [], [], []
                    held_nodes += nodes[lo:hi]
                    held_sides += sides[lo:hi]
                    held_sets += sets[lo:hi]
                yield _links_batch(np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64))
        yield _links_batch(decide())

    dealt = held.select(*meetings, "side", "node", "content").repartition(*meetings).sortWithinPartitions(*meetings, "node")
    return dealt.mapInArrow(confirm, "a long, b long")


def similar_components(units: DataFrame, contents: DataFrame, hashes_of, share: int, name: str, block: int = 256) -> DataFrame:
    """(node, component) of nodes that have a link of ``share`` hundredths or more to another node.

    units: (unit, node) of sets that may be similar, a written table.  contents: (node, content), read only for nodes in units.
    hashes_of: makes the sorted distinct shingle hashes of each content, given an Arrow array of contents.
    """
    # units of several blocks: few, and joined from the left, so that Spark may split a large one
    big = units.groupBy("unit").agg(F.count("*").alias("size")).where(F.col("size") > block).select("unit", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    placed = units.join(big, "unit", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # the first block meets itself and each other block
    meets = F.explode(F.expr("if(block = 0, sequence(0, blocks - 1), array(block))"))
    # a hash join of shuffled parts at every size: the units are a part of the nodes and a node is in few units, contents need no sort,
    # and those in a table bucketed by node stay where they are
    held = contents.join(placed.hint("shuffle_hash"), "node").select("unit", F.lit(0).alias("lo"), meets.alias("hi"), F.col("block").alias("side"), "node", "content")
    first = cut(connected_components(_confirmed(held, hashes_of, share), f"{name}-first"), f"{name}-first-components")
    # whoever is outside the largest component of a unit of several blocks meets all of it
    labelled = placed.where("blocks > 1").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = cut(labelled, f"{name}-labelled")
    main = labelled.groupBy("unit", "component").agg(F.count("*").alias("n")).groupBy("unit").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    outside = labelled.join(main, "unit").where("component != main")
    more = outside.groupBy("unit").agg(F.ceil(F.count("*") / block).cast("int").alias("others"))
    outside = outside.join(more, "unit").select("unit", "node", F.expr("explode(sequence(0, blocks - 1))").alias("hi"), F.expr("cast(-1 - pmod(xxhash64(node), others) as int)").alias("lo"), F.lit(1).alias("side"))
    inside = labelled.join(more, "unit").select("unit", "node", F.col("block").alias("hi"), F.expr("explode(sequence(-others, -1))").alias("lo"), F.lit(0).alias("side"))
    again = contents.join(outside.unionByName(inside).hint("shuffle_hash"), "node")
    rest = cut(_confirmed(again, hashes_of, share).where("a != b"), f"{name}-rest")
    known = first.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    found = cut(connected_components(known.unionByName(rest), f"{name}-true"), f"{name}-components")
    for spent in (first, labelled, rest):
        discard(spent)
    return found
