"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each of a few records, and a seek table in a skippable frame at its end. The index maps a record's id
to (bundle, frame, offset in the frame's plain bytes, length), so one record costs one frame. Of records with equal payloads one is the response and
the others are revisits that refer to it and carry no payload.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.session import new_folder, stored

#: Fixed values of the formats.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:page:"
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<II")

INDEX = "page_id long, bundle string, frame int, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class Record(NamedTuple):
    page_id: int | None
    url: str | None
    record_type: str
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{PAGE_URN}{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_KEPT)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{PAGE_URN}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest(sha1)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


_KEPT = "".join(chr(c) for c in range(0x21, 0x7F))


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _page(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").removeprefix(PAGE_URN)
    return int(name) if name.lstrip("-").isdigit() else None


def parsed(data: bytes, at: int = 0, stop: int | None = None) -> Iterator[Record]:
    """The records in ``data[at:stop]``; a payload that does not match its digest raises."""
    stop = len(data) if stop is None else stop
    while at < stop:
        head = data.index(b"\r\n\r\n", at)
        fields = _headers(data[at:head])
        begin = head + 4
        end = begin + int(fields["content-length"])
        http = data.index(b"\r\n\r\n", begin, end)
        stated = fields["warc-payload-digest"].removeprefix("sha1:")
        response = fields["warc-type"] == "response"
        payload = data[http + 4 : end] if response else None
        if response and digest(hashlib.sha1(payload).digest()) != stated:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
        size = len(payload) if response else int(_headers(data[begin:http])["content-length"])
        yield Record(_page(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], _page(fields.get("warc-refers-to")), size, stated, payload)
        at = end + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(ENTRY.pack(*s) for s in sizes) + FOOTER.pack(len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


@lru_cache(maxsize=8)
def _store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(folder)


def frames_of(folder: str, bundle: str) -> list[tuple[int, int, int]]:
    """(frame, where it begins, compressed size) from the seek table at the end of a bundle."""
    fs, root = _store(folder)
    with fs.open_input_file(f"{root}/{bundle}") as f:
        size = f.size()
        n, _, magic = FOOTER.unpack(f.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{bundle} has no seek table")
        table = f.read_at(n * ENTRY.size, size - FOOTER.size - n * ENTRY.size)
    out, at = [], 0
    for i, (packed, _) in enumerate(ENTRY.iter_unpack(table)):
        out.append((i, at, packed))
        at += packed
    return out


def _frame(folder: str, bundle: str, at: int, packed: int) -> bytes:
    fs, root = _store(folder)
    with fs.open_input_file(f"{root}/{bundle}") as f:
        return zstandard.ZstdDecompressor().decompress(f.read_at(packed, at))


def write(
    pages: DataFrame,
    folder: str | None = None,
    id: str = "page_id",
    url: str = "url",
    html: str = "html",
    revisit_bytes: int = 0,
    frame_bytes: int = 1 << 19,
    bundle_bytes: int = 1 << 30,
    date: str = "1970-01-01T00:00:00Z",
    level: int = 3,
) -> str:
    """Write a record for every row, and the index as a table ``index`` beside the bundles; returns the folder.

    Of records with equal payloads of at least ``revisit_bytes`` bytes the one with the largest id is the response; the others are revisits. Rows that
    repeat that id with that payload are responses too; a null id is below all others, and refers or is referred to only as such a row may: if all ids
    of a payload are null, all its records are responses. A null html is an empty payload. In a url, blanks, control characters and characters
    outside ASCII are percent-encoded; a null url is left out. Other columns are not read. An empty table gives an index without rows.

    The rows are joined to the response of their payload only where a payload repeats; a payload that fills much of the table is split by the engine,
    as nothing above the join needs its rows together. A task writes its own bundles under names of its attempt, so a repeated task leaves a bundle that
    no index row names, never a wrong one. Memory: one frame and one batch of rows.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    records = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    repeated = records.where(F.octet_length("payload") >= revisit_bytes).groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response")).where("n > 1").select("sha1", "response")
    rows = records.join(stored(repeated, "warc-repeated"), "sha1", "left")
    refers_to = F.when(F.col("response") > F.coalesce("page_id", F.col("response") - 1), F.col("response"))
    _store(folder)[0].create_dir(_store(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = _store(folder)
        packer = zstandard.ZstdCompressor(level=level)
        out, name, sizes, written, number = None, "", [], 0, 0
        held: list[bytes] = []
        places: list[tuple] = []
        size = 0

        def close_frame() -> list[tuple]:
            nonlocal size, written, held, places
            packed = packer.compress(b"".join(held))
            out.write(packed)
            sizes.append((len(packed), size))
            written += len(packed)
            done = [(p, name, len(sizes) - 1, at, n) for p, at, n in places]
            held, places, size = [], [], 0
            return done

        def close_bundle() -> None:
            nonlocal out
            out.write(seek_table(sizes))
            out.close()
            out = None

        def rows_of(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) if i else pa.array(x, pa.int64()) for i, x in enumerate(zip(*done, strict=True))], schema=_INDEX)

        for batch in batches:
            for page_id, link, body, sha, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "sha1", "refers_to")), strict=True):
                raw = record_bytes(page_id.as_py(), link.as_py(), body.as_py(), bytes.fromhex(sha.as_py()), refers.as_py(), date)
                if out is None:
                    name, sizes, written = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number}.warc.zst", [], 0
                    number += 1
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                places.append((page_id.as_py(), size, len(raw)))
                held.append(raw)
                size += len(raw)
                if size >= frame_bytes:
                    yield rows_of(close_frame())
                    if written >= bundle_bytes:
                        close_bundle()
        if out is not None:
            if held:
                yield rows_of(close_frame())
            close_bundle()

    made = rows.select("page_id", "url", "payload", "sha1", refers_to.alias("refers_to")).mapInArrow(run, INDEX)
    made.write.parquet(f"{folder}/index")
    return folder


_INDEX = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
_RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """bundle, frame, at, packed: the frames of all bundles that the index names, read from their seek tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                if found := frames_of(folder, bundle):
                    number, at, packed = zip(*found, strict=True)
                    yield pa.RecordBatch.from_pydict({"bundle": [bundle] * len(found), "frame": pa.array(number, pa.int32()), "at": list(at), "packed": list(packed)})

    return index(spark, folder).select("bundle").distinct().mapInArrow(run, "bundle string, frame int, at long, packed long")


def _records(found: list[Record], payloads: bool) -> pa.RecordBatch:
    rows = [r if payloads else r._replace(payload=None) for r in found]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _RECORD.types, strict=True)], schema=_RECORD)


def read(spark: SparkSession, folder: str, payloads: bool = True, task_frames: int = 16) -> DataFrame:
    """All records of the archives, a frame at a time: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Size and digest are of the full payload for revisits as well; their ``payload`` is null, as it is everywhere without ``payloads``.
    """
    known = stored(frames(spark, folder), "warc-frames")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, at, packed in zip(*(batch.column(c).to_pylist() for c in ("bundle", "at", "packed")), strict=True):
                yield _records(list(parsed(_frame(folder, bundle, at, packed))), payloads)

    return known.repartition(max(1, math.ceil(known.count() / task_frames))).mapInArrow(run, RECORD)


def lookup(spark: SparkSession, folder: str, wanted: DataFrame, id: str = "page_id") -> DataFrame:
    """The records with the ids of ``wanted``, like :func:`read`: the index gives frame and offset, and only those frames are read.

    An id that is asked twice is answered once; one without a record, or null, gives no row.
    """
    ids = wanted.select(F.col(id).cast("long").alias("page_id")).distinct()
    places = index(spark, folder).join(ids, "page_id").join(frames(spark, folder), ["bundle", "frame"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, data = None, b""
        for batch in batches:
            for bundle, at, packed, offset, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "at", "packed", "offset", "length")), strict=True):
                if last != (bundle, at):
                    last, data = (bundle, at), _frame(folder, bundle, at, packed)
                yield _records(list(parsed(data, offset, offset + length)), True)

    return places.sortWithinPartitions("bundle", "at").mapInArrow(run, RECORD)
