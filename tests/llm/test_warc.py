import hashlib
import struct

import zstandard

from cairnframe.llm import warc

BIG = "<p>" + "long enough to be a revisit " * 10 + "</p>"


def test_round_trip(spark):
    rows = [(3, "http://a/3", BIG, "k"), (1, "http://a/1", BIG, "k"), (2, None, None, "k"), (4, "u%\n", "", "k"), (5, "v", "short", "k"), (6, "v", "short", "k"), (1, "twice", BIG, "k"), (None, "n", BIG, "k"), (8, "w", "é" * 60, "k"), (9, "x", "y" * 300_000, "k"), (9, "x", "z" * 300_000, "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    bundles = warc.write(df)
    got = sorted(((r.page_id is None, r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.query(df).collect())
    want = []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        firsts = [j for j, _, h, _ in rows if (h or "").encode() == raw and j is not None]
        revisit = len(raw) >= 100 and bool(firsts) and i != min(firsts)
        want.append(((i is None, i or 0), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", min(firsts) if revisit else None))
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2], x[3]))
    texts = {(r.key, bytes(r.payload).decode()) for r in warc.read(bundles).collect() if r.payload is not None}
    assert ("9", "y" * 300_000) in texts and ("2", "") in texts and ("1", BIG) in texts


def test_keys_of_any_text(spark):
    rows = [(k, BIG) for k in ("null", None, "a%b", "=", "", "\nline")] + [("x", "small")]
    df = spark.createDataFrame([(k, "u", h, 1, 2) for k, h in rows], "page_id string, url string, html string, mark int, first int")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.query(df).collect()}
    assert got == {k: ("response", None) if k in ("", "x") else ("revisit", "") for k, _ in rows}
    assert {r.key for r in warc.index(warc.write(df)).collect()} == {k for k, _ in rows}
    renamed = spark.createDataFrame([(None if k is None else "k%" + k, "u", h) for k, h in rows], "page_id string, url string, html string")
    assert {r.refers_to for r in warc.query(renamed).collect()} == {None, "k%"}


def test_bundles_are_seekable_zstandard(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"{i} " * 40_000) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    bundles = warc.write(df)
    out = warc.export(bundles, str(tmp_path)).collect()
    data = open(out[0].path, "rb").read()
    count, _, magic = struct.unpack("<IBI", data[-9:])
    assert magic == warc.SEEKABLE and count > 1
    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data[: -17 - 8 * count])
    for r in warc.index(bundles).collect():  # a record is read from its frame alone, and lies in the stream that any reader sees
        frame = warc.frame(data, warc.seek_table(data)[r.frame])
        record = frame[r.offset : r.offset + r.length]
        assert record.startswith(b"WARC/1.1\r\n") and record in whole
        assert warc.parsed(record)[1].decode() == f"{r.key} " * 40_000


def test_empty_table(spark):
    assert warc.query(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
