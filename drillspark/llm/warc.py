"""WARC archives as seekable Zstandard bundles.

A page becomes a WARC record; records are grouped into independent Zstandard
frames of about ``frame_bytes``, frames into bundle files of about
``bundle_bytes`` (both before compression). A bundle file is

    frames | skippable frame with the record index | seek table

The seek table is the footer of the public seekable format: a skippable frame
with the compressed and plain size of every frame, so a reader finds a frame
without touching the others. The index maps each record identifier to its
frame and the offset and length within that frame. Plain ``zstd`` tools read
such a file as one stream of records.

Equal payloads: among records with the same payload of at least
``revisit_bytes``, the one with the largest identifier is a ``response``; the
others become ``revisit`` records that carry headers only and name it.
Shorter payloads are always responses.

Files are written by Spark's own text writer, which puts bytes as they are and
commits each task's files in one step, so a lost executor or a second attempt
leaves no torn or doubled bundle, on any file system that Spark can reach.

Defined cases: a null payload is empty; a null URL gives no target header; rows
that share the largest identifier and the payload are all responses; a null
identifier is written as ``null`` and is never the largest (where no row of a
payload has one, all are responses). A payload larger than a bundle gets a frame
and a bundle of its own. An empty table is a folder without bundles and reads back
empty. Only the three named columns are read, whatever else there is.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import struct
import sys
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ..session import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
HEADER_BYTES = 400  # of a record besides its URL and payload: empty pages fill bundles, too
REVISIT_BYTES = 1000

# Fixed values of the seekable Zstandard format and of WARC
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = b"\xb1\xea\x92\x8f"
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URI = "urn:page:"
DATE = "2000-01-01T00:00:00Z"

READ_SCHEMA = StructType(
    [
        StructField("record_id", StringType()),
        StructField("url", StringType()),
        StructField("record_type", StringType()),
        StructField("payload_digest", StringType()),
        StructField("payload_bytes", LongType()),
        StructField("refers_to", StringType()),
        StructField("payload", BinaryType()),
        StructField("bundle", StringType()),
        StructField("frame", IntegerType()),
        StructField("frame_offset", LongType()),
        StructField("record_bytes", LongType()),
    ]
)


def _header_value(text: str) -> tuple[str, bool]:
    """A header-safe form of a value, and whether it had to be escaped."""
    if text and text == text.strip() and text.isprintable():
        return text, False
    return quote(text, safe=""), True


def record_bytes(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record: a response with its payload, or (``refers_to`` given)
    a revisit that keeps the HTTP header, with the payload's length, only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = [
        WARC_VERSION,
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD_URI}{quote(record_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha}",
    ]
    if url is not None:
        value, escaped = _header_value(url)
        lines.append(f"WARC-Target-URI: {value}")
        if escaped:
            lines.append("X-Target-URI-Escaped: 1")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_URI}{quote(refers_to)}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record; a response's digest and length are taken from
    its payload, and a digest that differs from the header's is an error."""
    head, _, block = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    promised = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = headers["WARC-Type"]
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != promised):
        raise ValueError(f"record {headers['WARC-Record-ID']}: payload and digest differ")
    url = headers.get("WARC-Target-URI")
    uri = lambda name: unquote(headers[name].strip("<>").removeprefix(RECORD_URI)) if name in headers else None
    return {
        "record_id": uri("WARC-Record-ID"),
        "url": unquote(url) if url is not None and "X-Target-URI-Escaped" in headers else url,
        "record_type": kind,
        "payload_digest": promised,
        "payload_bytes": length,
        "refers_to": uri("WARC-Refers-To"),
        "payload": payload if kind == "response" else None,
    }


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class Bundle:
    """Collects records into frames; ``finish`` gives the file's bytes."""

    def __init__(self, frame_bytes: int, level: int):
        import zstandard

        self._squeeze = zstandard.ZstdCompressor(level=level)
        self._frame_bytes = frame_bytes
        self._open: list[bytes] = []
        self._open_size = 0
        self._frames: list[bytes] = []
        self._sizes: list[tuple[int, int]] = []
        self._index: list[tuple[str, int, int, int]] = []
        self.plain = 0

    def add(self, record_id: str, record: bytes) -> None:
        self._index.append((record_id, len(self._frames), self._open_size, len(record)))
        self._open.append(record)
        self._open_size += len(record)
        self.plain += len(record)
        if self._open_size >= self._frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self._open:
            frame = self._squeeze.compress(b"".join(self._open))
            self._frames.append(frame)
            self._sizes.append((len(frame), self._open_size))
            self._open, self._open_size = [], 0

    def finish(self) -> bytes:
        self._close_frame()
        index = _skippable(SKIPPABLE_INDEX, self._squeeze.compress(json.dumps(self._index).encode()))
        # the index frame holds no plain bytes, and is listed so that offsets add up
        sizes = [*self._sizes, (len(index), 0)]
        table = b"".join(struct.pack("<II", *s) for s in sizes)
        footer = struct.pack("<IB", len(sizes), 0) + SEEKABLE_MAGIC
        return b"".join(self._frames) + index + _skippable(SKIPPABLE_SEEK_TABLE, table + footer)


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the footer."""
    if data[-4:] != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle: no seek table at its end")
    (count,) = struct.unpack("<I", data[-9:-5])
    sizes = struct.iter_unpack("<II", data[-9 - 8 * count : -9])
    out, at = [], 0
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


def record_index(data: bytes) -> list[tuple[str, int, int, int]]:
    """(record id, frame, offset in the frame, length) of every record."""
    import zstandard

    at, size, _ = seek_table(data)[-1]
    return [tuple(x) for x in json.loads(zstandard.ZstdDecompressor().decompress(data[at + 8 : at + size]))]


def read_one(data: bytes, record_id: str) -> list[dict]:
    """The records with this identifier, unpacking only the frames they are in."""
    import zstandard

    frames, found = seek_table(data), []
    for name, frame, offset, length in record_index(data):
        if name == record_id:
            at, size, _ = frames[frame]
            plain = zstandard.ZstdDecompressor().decompress(data[at : at + size])
            found.append(parse_record(plain[offset : offset + length]))
    return found


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` plus ``payload_digest`` (hex SHA-1), and ``refers_to``, the
    identifier of the response it repeats, null for a response.

    The largest identifier of each payload is found by an aggregation that
    combines within the tasks; only payloads that occur more than once are
    joined back. They come from a written table, so both sides of the join are
    exchanged and a very common payload's rows can be split by skew handling."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    sized = pages.withColumn("payload_digest", F.sha1(payload)).withColumn("__n", F.octet_length(payload))
    owners = (
        sized.where(F.col("__n") >= revisit_bytes)
        .groupBy(F.col("payload_digest").alias("__d"))
        .agg(F.max(id_col).alias("__owner"), F.count(F.lit(1)).alias("__k"))
        .where("__k > 1")
        .drop("__k")
    )
    owners = checkpointed(owners)
    same = (F.col("payload_digest") == F.col("__d")) & (F.col("__n") >= revisit_bytes)
    repeats = F.col("__owner").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__owner"))
    return (
        sized.join(owners, same, "left")
        .withColumn("refers_to", F.when(repeats, F.col("__owner")))
        .drop("__d", "__owner", "__n")
    )


def write_bundles(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
    level: int = 6,
) -> None:
    """Write ``pages`` as bundle files in the new folder ``path``. Rows are
    dealt out evenly to as many tasks as there are bundles' worth of bytes."""
    rows = with_revisits(pages.select(id_col, url_col, payload_col), id_col, payload_col, revisit_bytes).select(
        F.col(id_col).cast("string").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
        F.col("payload_digest").alias("digest"),
        F.col("refers_to").cast("string").alias("refers_to"),
    )
    record = F.coalesce(F.octet_length(payload_col), F.lit(0)) + F.coalesce(F.octet_length(url_col), F.lit(0)) + HEADER_BYTES
    total = pages.agg(F.sum(record.cast("long"))).first()[0] or 0
    tasks = max(1, math.ceil(total / bundle_bytes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(bundle):
            # the writer puts the last four bytes itself, after every row
            return pa.RecordBatch.from_arrays([pa.array([bundle.finish()[:-4]], pa.binary())], ["bundle"])

        bundle = Bundle(frame_bytes, level)
        for batch in batches:
            for r in batch.to_pylist():
                name = "null" if r["id"] is None else r["id"]
                bundle.add(name, record_bytes(name, r["url"], r["payload"], r["digest"], r["refers_to"]))
                if bundle.plain >= bundle_bytes:
                    yield row(bundle)
                    bundle = Bundle(frame_bytes, level)
        if bundle.plain:
            yield row(bundle)

    (
        rows.repartition(tasks)
        .mapInArrow(pack, "bundle binary")
        .select(F.col("bundle").cast("string").alias("value"))
        .write.option("lineSep", SEEKABLE_MAGIC.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def read_bundles(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the bundles in ``path`` (columns of ``READ_SCHEMA``),
    read frame by frame through the seek table and the record index."""
    names = [f.name for f in READ_SCHEMA if with_payload or f.name != "payload"]
    schema = StructType([f for f in READ_SCHEMA if f.name in names])
    arrow = to_arrow_schema(schema)

    def unpack(batches):
        import zstandard

        open_frame = zstandard.ZstdDecompressor()
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = data.as_py()
                if not data:  # the writer leaves an empty file for an empty table
                    continue
                frames, by_frame = seek_table(data), {}
                for name, frame, offset, length in record_index(data):
                    by_frame.setdefault(frame, []).append((name, offset, length))
                for frame, entries in by_frame.items():
                    at, size, _ = frames[frame]
                    plain = open_frame.decompress(data[at : at + size])
                    rows = []
                    for name, offset, length in entries:
                        record = parse_record(plain[offset : offset + length])
                        if record["record_id"] != name:
                            raise ValueError(f"{file}: the index has {name} where {record['record_id']} lies")
                        record |= {"bundle": file, "frame": frame, "frame_offset": offset, "record_bytes": length}
                        rows.append({k: record[k] for k in names})
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return _files(spark, path).select("path", "content").mapInArrow(unpack, schema)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Record identifier, bundle, frame, offset in the frame and length of
    every record, without unpacking any frame but the index."""
    schema = "record_id string, bundle string, frame int, frame_offset long, record_bytes long"

    def unpack(batches):
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = record_index(data.as_py()) if len(data.as_py()) else []
                cols = list(zip(*rows)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cols[0], pa.string()),
                        pa.array([file] * len(rows), pa.string()),
                        pa.array(cols[1], pa.int32()),
                        pa.array(cols[2], pa.int64()),
                        pa.array(cols[3], pa.int64()),
                    ],
                    ["record_id", "bundle", "frame", "frame_offset", "record_bytes"],
                )

    return _files(spark, path).select("path", "content").mapInArrow(unpack, schema)
