import hashlib
import io
import struct

import zstandard

from helixframe.llm import warc
from helixframe.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string"
LONG = "<html>" + "körper " * 40 + "</html>"


def pages():
    rows = [(i, f"http://x.example/{i}", f"<html><p>page {i} {'text ' * 60}</p></html>") for i in range(40)]
    rows += [(100 + i, f"http://y.example/{i}", LONG) for i in range(5)]
    rows += [(50, "http://y.example/first", LONG), (50, "http://y.example/first", LONG), (200, None, None), (201, "bad\r\nurl: x", "tiny"), (202, "u", "tiny"), (None, "u", LONG), (203, "u", "x" * 100), (204, "u", "x" * 100), (205, "u", "x" * 99), (206, "u", "x" * 99), (207, "u", "y" * 3_000_000)]
    return rows


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' AS digest", "'b' AS refers_to", "1 AS path")
    manifest = warc.write_archives(df, scratch_path(spark, "warc"))
    found = warc.read_archives(manifest).collect()
    assert len(found) == len(rows) == sum(r["records"] for r in manifest.collect())
    first = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if page_id is not None and len(data) >= 100:
            first[data] = min(first.get(data, page_id), page_id)
    wanted = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        owner = first.get(data, page_id) if page_id is not None else None
        revisit = page_id is not None and owner != page_id
        wanted.append((str(page_id), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", owner if revisit else None, None if revisit else data))
    got = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in found]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_archive_layout():
    out = io.BytesIO()
    out.close = lambda: None
    writer = warc.ArchiveWriter(out)
    for i in range(200):
        writer.add(warc.page_record(i, f"http://x/{i}", f"<html>page {i} {'common words here ' * 20}</html>".encode(), None))
    writer.close()
    data = out.getvalue()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.DICTIONARY_MAGIC and 0x184D2A50 <= magic <= 0x184D2A5F
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    # Any frame can be read alone, and holds one record.
    at, count = 8 + size, 0
    while at < len(data):
        unpacker = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        record = unpacker.decompress(data[at:])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        at, count = len(data) - len(unpacker.unused_data), count + 1
    assert count == 201
    assert len(list(warc.open_archive(io.BytesIO(data)))) == 201


def test_archive_without_dictionary():
    out = io.BytesIO()
    out.close = lambda: None
    writer = warc.ArchiveWriter(out)
    writer.add(warc.page_record(1, None, b"x", None))
    writer.close()
    assert [h["WARC-Type"] for h, _ in warc.open_archive(io.BytesIO(out.getvalue()))] == ["warcinfo", "response"]


def test_header_values_stay_on_one_line():
    head = warc.page_record(1, "a\r\nWARC-Type: evil", b"", None).split(b"\r\n\r\n")[0]
    assert head.count(b"WARC-Type:") == 2 and b"\r\nWARC-Type: evil" not in head


def test_empty_table(spark):
    manifest = warc.write_archives(spark.createDataFrame([], SCHEMA), scratch_path(spark, "warc"))
    assert warc.read_archives(manifest).count() == 0
