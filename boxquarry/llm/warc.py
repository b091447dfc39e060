"""Seekable Zstandard bundles of WARC records.

A bundle is a file of independent Zstandard frames, each holding some whole records, and a last skippable frame with
the seek table of the seekable format: sizes of each frame before and after compression.  An index maps a record to
(bundle, frame, offset in the frame, length).  Tasks write bundles to the shared folder under names of their own
and the index names the bundles that count, so a task that is lost or runs twice does no harm.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from boxquarry.llm.storage import cut, new_path

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_END = b"\r\n\r\n"
_DATE = "2000-01-01T00:00:00Z"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes | memoryview) -> list[tuple[int, int]]:
    """(start, compressed size) of each frame; ValueError if the footer isn't one."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    width = 12 if flags & 0x80 else 8
    size = count * width + 9
    head = struct.unpack("<II", bundle[-size - 8 : -size])
    if magic != SEEKABLE or head != (SKIPPABLE, size):
        raise ValueError("no seek table at the end of the bundle")
    out, at = [], 0
    for k in range(count):
        packed, _ = struct.unpack_from("<II", bundle, len(bundle) - size + k * width)
        out.append((at, packed))
        at += packed
    return out


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload of its own but names its size and the record that holds it."""
    body = b"" if kind == "revisit" else payload
    uri = re.sub(r"[\r\n]+", " ", url or "urn:page:null")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + _END + body + _END


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """Headers by lower-case name and ``payload`` of the record at this offset, and the offset after it."""
    head = data.index(_END, at)
    lines = data[at:head].decode("utf-8", "surrogatepass").split("\r\n")
    out: dict = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    begin = head + len(_END)
    end = begin + int(out["content-length"])
    out["payload"] = data[begin:end]
    return out, end + len(_END)


def parse_row(data: bytes, at: int = 0) -> tuple[tuple, int]:
    """The columns of RECORD_SQL of the record at this offset, and the offset after it."""
    found, after = parse_record(data, at)
    number = lambda v: None if v is None or v == "<urn:page:null>" else int(v[len("<urn:page:") : -1])
    row = (number(found["warc-record-id"]), found["warc-type"], found["warc-payload-digest"].removeprefix("sha256:"), int(found["x-payload-length"]), number(found.get("warc-refers-to")), found["warc-target-uri"], found["payload"])
    return row, after


RECORD_SQL = "id long, record_type string, payload_digest string, payload_bytes long, refers_to long, target_uri string, payload binary"
_RECORD = pa.schema([("id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())])


def _rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(_RECORD.names)}, schema=_RECORD)


_INDEX = "id long, bundle string, frame int, offset long, length long"


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, frame_bytes: int = 1 << 18, bundle_bytes: int = 32 << 20) -> DataFrame:
    """Write a record for each row to bundles under ``folder``; the index (id, bundle, frame, offset, length).

    Of records with equal payloads (UTF-8, null is empty) of ``least`` bytes or more, the one with the smallest id, null ids last, is a
    response and the others revisit it; of rows with one id and one payload exactly one is.  Smaller ones are all responses.  Frames hold whole
    records of about ``frame_bytes``, bundles about ``bundle_bytes``; a larger record has them to itself.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    # of each payload with copies: its smallest id, null last, and how many rows have that id
    counts = rows.where(F.col("size") >= least).groupBy("digest", "id").agg(F.count("*").alias("same"))
    first = counts.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "same")).alias("first"), F.sum("same").alias("copies"))
    first = cut(first.where("copies > 1"), "warc-copies")
    # a digest of many rows may be split between tasks: this is a plain equality join
    known = rows.join(first.hint("merge"), "digest", "left").withColumn("leads", F.col("id").eqNullSafe(F.col("first.id")))
    kind = F.when(F.col("copies").isNotNull() & ~F.col("leads"), "revisit").otherwise("response")
    if first.where("first.same > 1").isEmpty():
        known = known.withColumn("kind", kind)
    else:  # rows with one id and one payload: any of them is the response
        tied = F.coalesce(F.col("leads") & (F.col("first.same") > 1), F.lit(False))
        one = F.row_number().over(W.partitionBy("digest").orderBy("url")) == 1
        known = known.where(~tied).withColumn("kind", kind).unionByName(known.where(tied).withColumn("kind", F.when(one, "response").otherwise("revisit")))
    known = known.select("id", "url", F.when(F.col("kind") == "response", F.col("payload")).alias("payload"), "digest", "size", "kind", F.when(F.col("kind") == "revisit", F.col("first.id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        files.create_dir(where, recursive=True)
        press = zstandard.ZstdCompressor(level=3)
        name, out, frames, plain, held, index = "", None, [], 0, [], []

        def flush_frame() -> None:
            nonlocal held, plain
            if held:
                data = b"".join(held)
                packed = press.compress(data)
                out.write(packed)
                frames.append((len(packed), len(data)))
                held, plain = [], 0

        def close() -> pa.RecordBatch:
            nonlocal out, frames, index
            flush_frame()
            out.write(seek_table(frames))
            out.close()
            batch = pa.RecordBatch.from_pydict({k: [x[n] for x in index] for n, k in enumerate(("id", "bundle", "frame", "offset", "length"))}, schema=pa.schema([("id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
            out, frames, index = None, [], []
            return batch

        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "payload", "digest", "size", "kind", "refers_to")]
            for k in range(len(batch)):
                page_id, url, body, digest, size, kind, refers = (c[k].as_py() for c in columns)
                data = record(kind, page_id, url, body or b"", digest, size, refers)
                if held and plain + len(data) > frame_bytes:
                    flush_frame()
                    if out.tell() >= bundle_bytes:
                        yield close()
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = files.open_output_stream(f"{where}/{name}", compression=None)
                index.append((page_id, name, len(frames), plain, len(data)))
                held.append(data)
                plain += len(data)
        if out is not None:
            yield close()

    return known.mapInArrow(run, _INDEX)


def read_bundles(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """All records of the bundles that an index names, frame by frame; each task holds one bundle.

    Bundles that the index doesn't name, such as those of a lost task, aren't read.  The driver gets one name for each bundle, as it
    does for each file of any table that Spark reads.
    """
    names = [r["bundle"] for r in index.select("bundle").distinct().collect()]
    files = spark.read.format("binaryFile").load([f"{folder}/{n}" for n in names]).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(len(batch)):
                bundle = batch.column("content")[k].as_buffer()
                bundle = memoryview(bundle)
                for start, size in read_seek_table(bundle):
                    data, at, rows = unpack.decompress(bundle[start : start + size]), 0, []
                    while at < len(data):
                        row, at = parse_row(data, at)
                        rows.append(row)
                    yield _rows_batch(rows)

    return files.mapInArrow(run, RECORD_SQL)


def fetch_records(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The records that these rows of an index map to: of each bundle, only the frames in question are unpacked."""
    places = wanted.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("frame", "offset"))).alias("places"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("bundle"), "content").join(places, "bundle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(len(batch)):
                bundle, rows, open_frame, data = memoryview(batch.column("content")[k].as_buffer()), [], -1, b""
                frames = read_seek_table(bundle)
                for place in batch.column("places")[k].as_py():
                    if place["frame"] != open_frame:
                        open_frame = place["frame"]
                        start, size = frames[open_frame]
                        data = unpack.decompress(bundle[start : start + size])
                    rows.append(parse_row(data, place["offset"])[0])
                yield _rows_batch(rows)

    return files.select("content", "places").mapInArrow(run, RECORD_SQL)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to bundles, read them back, and return (page_id, payload_bytes, payload_digest, record_type, refers_to, stored_bytes, intact).

    stored_bytes is the size of the record's own payload and intact says whether its digest and size, recomputed from the
    archive, are those of its header (for revisits: whether it has no payload).  Null html is an empty payload; null urls are written
    as ``urn:page:null``; repeated rows are written each; extra columns are ignored; an empty table gives no rows.  Ids are whole numbers: a text
    that is none raises.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    index = cut(write_bundles(pages, folder), "warc-index")
    if index.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, stored_bytes long, intact boolean")
    back = read_bundles(spark, folder, index)
    stored = F.octet_length("payload").cast("long")
    whole = (F.sha2("payload", 256) == F.col("payload_digest")) & (stored == F.col("payload_bytes"))
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", stored.alias("stored_bytes"), F.when(F.col("record_type") == "revisit", stored == 0).otherwise(whole).alias("intact"))
