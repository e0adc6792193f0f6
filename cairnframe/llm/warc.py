"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a bundle is a run of frames and, in a skippable
frame at its end, a seek table of their sizes, so that any record is read by decompressing one frame.
The index maps a record's identifier to its bundle, frame, and place within the decompressed
frame. Pages whose payload another page has already are revisit records.

A bundle is the bytes of a .warc.zst file. Spark writes bundles as rows of a Parquet table, so
that its commit protocol covers lost executors and any file system that it writes to will do;
export() puts them out as files.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sifted, stored

#: Bytes of records in a frame and of frames in a bundle, about; payloads shorter than LEAST are never revisits.
FRAME, BUNDLE, LEAST, LEVEL = 1 << 18, 1 << 25, 100, 3
# Fixed values of the seekable format: the skippable frame's magic number and the seek table's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_WHEN = datetime(2000, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(key: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 response record, or a revisit one if refers_to is given. key and refers_to: identifiers, of any characters."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, key)}>",
        f"WARC-Date: {_WHEN}",
        f"WARC-Target-URI: {_line(url or 'urn:none')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Record-Key: {_line(key)}",
    ]
    body = _HTTP + payload
    if refers_to is not None:
        body = _HTTP
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, refers_to)}>", f"X-Refers-To-Key: {_line(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _line(value: str) -> str:
    """A header's value on one line: control characters and "%" as in URLs."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in value)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record."""
    head, _, body = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        headers[name.lower()] = value
    body = body[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


class Bundle:
    """Frames so far, with where each record went."""

    def __init__(self):
        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.places: list[tuple[int, int, int]] = []  # frame, offset in it, length
        self.open, self.filled, self.bytes = [], 0, 0

    def add(self, raw: bytes) -> None:
        self.places.append((len(self.frames), self.filled, len(raw)))
        self.open.append(raw)
        self.filled += len(raw)
        if self.filled >= FRAME:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.filled))
            self.bytes += len(frame)
            self.open, self.filled = [], 0

    def finished(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """From the footer alone: each frame's start, compressed and decompressed size."""
    count, _, magic = struct.unpack_from("<IBI", bundle, len(bundle) - 9)
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", bundle[len(bundle) - 9 - 8 * count : len(bundle) - 9]):
        out.append((at, packed, plain))
        at += packed
    return out


def frame(bundle: bytes, place: tuple[int, int, int]) -> bytes:
    at, packed, plain = place
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=plain)


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """The stored bundles of pages: bundle (number), data, and for each record its key and place: arrays keys, frames, offsets, lengths.

    Null payloads are empty. Of rows with equal payloads of ``least`` bytes or more, those with the
    smallest key are responses, the rest revisits of it; without any key all are responses. Keys
    are compared as they are and written as text after "="; a null key is the empty text.
    """
    raw = F.coalesce(F.encode(F.col(payload).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # Payloads that several rows have; few enough columns that hot ones cost no more than others.
    seen = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    seen = stored(seen.select(F.col("digest").alias("of"), "first"), "repeated")
    revisits = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("key"))
    # Only payloads that may be repeated go through the join.
    maybe, single = sifted(rows.withColumn("mark", F.xxhash64("digest")), F.col("mark"), seen.withColumn("of_mark", F.xxhash64("of")), "of_mark")
    joined = maybe.join(seen, F.col("digest") == F.col("of"), "left").withColumn("refers_to", F.when(revisits, F.concat(F.lit("="), F.col("first").cast("string"))))
    both = joined.drop("of", "first").unionByName(single.withColumn("refers_to", F.lit(None).cast("string")))
    ready = both.select(F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("")).alias("key"), "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        bundle, keys = Bundle(), []

        def done() -> pa.RecordBatch:
            data = bundle.finished()
            columns = [pa.array([c], pa.list_(pa.int64())) for c in zip(*bundle.places, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([data], pa.binary()), pa.array([keys], pa.list_(pa.string())), *columns], names=["bundle", "data", "keys", "frames", "offsets", "lengths"])

        for batch in batches:
            for k, u, p, d, r in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "payload", "digest", "refers_to")), strict=True):
                bundle.add(record(k, u, p, d, r))
                keys.append(k)
                if bundle.bytes >= BUNDLE:
                    yield done()
                    bundle, keys, number = Bundle(), [], number + 1
        if keys:
            yield done()

    schema = "bundle long, data binary, keys array<string>, frames array<long>, offsets array<long>, lengths array<long>"
    return stored(ready.mapInArrow(run, schema), "bundles")


def read(bundles: DataFrame) -> DataFrame:
    """A row per record, read from the bundles by their seek tables and index: key, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits), bundle, frame.

    A response's payload is digested anew; one that differs from its header is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                data = batch.column("data")[i].as_py()
                table, at, plain, out = seek_table(data), -1, b"", []
                for k, f, offset, length in zip(*(batch.column(c)[i].as_py() for c in ("keys", "frames", "offsets", "lengths")), strict=True):
                    if f != at:
                        at, plain = f, frame(data, table[f])
                    headers, payload = parsed(plain[offset : offset + length])
                    digest, size = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["x-payload-length"])
                    is_response = headers["warc-type"] == "response"
                    if headers["x-record-key"] != _line(k) or is_response and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"damaged record {k}")
                    refers = headers.get("x-refers-to-key")
                    out.append((k[1:] if k else None, headers["warc-target-uri"], size, digest, headers["warc-type"], refers and unquote(refers)[1:], payload if is_response else None, batch.column("bundle")[i].as_py(), f))
                    if len(out) == 512:
                        yield _records(out)
                        out = []
                if out:
                    yield _records(out)

    return bundles.mapInArrow(run, _READ)


_READ = "key string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary, bundle long, frame long"
_ARROW = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]


def _records(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=[f.split()[0] for f in _READ.split(", ")])


def index(bundles: DataFrame) -> DataFrame:
    """key, bundle, frame, offset and length (in the decompressed frame) of every record."""
    return bundles.select("bundle", F.explode(F.arrays_zip("keys", "frames", "offsets", "lengths")).alias("r")).select(F.when(F.col("r.keys") != "", F.substring("r.keys", 2, 1 << 30)).alias("key"), "bundle", F.col("r.frames").alias("frame"), F.col("r.offsets").alias("offset"), F.col("r.lengths").alias("length"))


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle to folder (mounted on every executor) as <number>.warc.zst, by renaming a finished file; returns bundle, path and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for number, data in zip(batch.column("bundle").to_pylist(), batch.column("data").to_pylist(), strict=True):
                path = os.path.join(folder, f"{number:016x}.warc.zst")
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, path)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([path]), pa.array([len(data)], pa.int64())], names=["bundle", "path", "size"])

    return bundles.select("bundle", "data").mapInArrow(run, "bundle long, path string, size long")


def query(pages: DataFrame) -> DataFrame:
    pages = pages.select("page_id", "url", "html")
    page_id = pages.schema["page_id"].dataType
    got = read(write(pages))
    return got.select(F.col("key").cast(page_id).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(page_id).alias("refers_to"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.d
"""
