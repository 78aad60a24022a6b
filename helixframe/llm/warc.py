"""Dictionary-compressed WARC archives.

Every archive starts with a skippable Zstandard frame (magic 0x184D2A5D) that holds a
dictionary trained on the archive's first records; then each record is a frame of its
own, compressed with that dictionary, so any record can be read alone.  A page whose
payload equals that of a page of smaller id is a revisit record without the payload.

Archives lie in a folder that driver and executors share; a task writes under a name of
its own and renames when it is done, so that a task that is run again replaces its file.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import materialize
from helixframe.shipping import arrow_map

DICTIONARY_MAGIC = 0x184D2A5D
#: Payloads of fewer bytes are never revisits.
LEAST_PAYLOAD = 100
#: Bytes of records on which a dictionary is trained, its size, and bytes at which the next archive of a task begins.
SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES, LEVEL = 4 << 20, 64 << 10, 256 << 20, 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


# --------------------------------------------------------------------------- records


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value)


def _record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_urn(page_id: int | None) -> str:
    return f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record where ``refers_to`` names the page it repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.insert(0, ("WARC-Target-URI", _clean(url)))
    if refers_to is None:
        return _record("response", page_urn(page_id), fields, http + payload)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{page_urn(refers_to)}>")]
    return _record("revisit", page_urn(page_id), fields, http)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an uncompressed WARC stream."""
    source = io.BufferedReader(stream, 1 << 20)
    while line := source.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := source.readline()) != b"\r\n":
            if not line:
                raise ValueError("a record breaks off in its header")
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        block = source.read(int(head["Content-Length"]))
        if len(block) != int(head["Content-Length"]) or source.read(4) != b"\r\n\r\n":
            raise ValueError("a record breaks off in its block")
        yield head, block


# --------------------------------------------------------------------------- archives


class ArchiveWriter:
    """One archive: collects records for the dictionary, then writes frame by frame."""

    def __init__(self, stream):
        self.stream, self.waiting, self.held, self.packer, self.written = stream, [], 0, None, 0
        self.add(_record("warcinfo", f"urn:uuid:{uuid.uuid4()}", [("Content-Type", "application/warc-fields")], b"software: helixframe\r\nformat: WARC File Format 1.1\r\n"))

    def add(self, record: bytes) -> None:
        if self.packer is not None:
            self._frame(record)
            return
        self.waiting.append(record)
        self.held += len(record)
        if self.held >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        dictionary = None
        if len(self.waiting) > 8:
            try:
                dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, self.held // 16)), self.waiting, level=LEVEL)
            except zstandard.ZstdError:  # too few or too small records: the archive has no dictionary frame
                dictionary = None
        if dictionary is not None:
            body = dictionary.as_bytes()
            self.stream.write(struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        for record in self.waiting:
            self._frame(record)
        self.waiting = []

    def _frame(self, record: bytes) -> None:
        body = self.packer.compress(record)
        self.stream.write(body)
        self.written += len(body)

    def close(self) -> None:
        if self.packer is None:
            self._begin()
        self.stream.close()


def open_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive, from a binary stream; memory holds one record and the dictionary."""
    head = stream.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        dictionary = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", head[4:])[0]))
        head = b""

    class Rest(io.RawIOBase):
        def __init__(self):
            self.first = head

        def readable(self):
            return True

        def readinto(self, target):
            data = self.first or stream.read(len(target))
            self.first = data[len(target) :] if self.first else b""
            data = data[: len(target)]
            target[: len(data)] = data
            return len(data)

    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
    yield from read_records(unpacker.stream_reader(Rest(), read_across_frames=True))


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _write(folder: str):
    """mapInArrow function: archives of this task's rows; a row ``(path, records)`` for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _file_system(folder)
        task, paths, counts = TaskContext.get(), [], []
        writer, own, count = None, "", 0

        def done():
            writer.close()
            final = f"{root}/part-{task.partitionId():06d}-{len(paths):03d}.warc.zst"
            files.move(own, final)
            paths.append(f"{folder}/{final.rpartition('/')[2]}")
            counts.append(count)

        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if writer is None:
                    own = f"{root}/.{task.taskAttemptId()}-{uuid.uuid4().hex}"
                    writer, count = ArchiveWriter(files.open_output_stream(own, compression=None)), 0
                writer.add(page_record(page_id, url, (html or "").encode("utf-8", "replace"), refers))
                count += 1
                if writer.written >= ARCHIVE_BYTES:
                    done()
                    writer = None
        if writer is not None:
            done()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    return run


def _digest(html):
    return F.sha2(html, 256)


def write_archives(pages: DataFrame, folder: str, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """Write a record for every row of ``pages`` to archives in ``folder``; returns their manifest ``(path, records)``.

    Reads ``page_id``, ``url`` and ``html``; other columns are ignored.  A null html is an empty
    payload.  Of equal payloads of at least ``least_payload`` bytes the smallest page_id is the
    response and all larger ids revisit it; rows that share that id are all responses, and so
    are rows without an id.  The folder must be new.  Payloads cross one shuffle, dealt by
    page_id; which pages revisit is settled on digests before.
    """
    spark = pages.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keys = materialize(rows.where(f"page_id IS NOT NULL AND octet_length(html) >= {int(least_payload)}").select("page_id", _digest(F.col("html")).alias("digest")), "payloads")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").select("digest", "refers_to")
    revisits = materialize(keys.join(first, "digest").where("page_id > refers_to").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to").distinct(), "revisits")
    marked = rows.join(revisits, (F.col("page_id") == F.col("p")) & (_digest(F.col("html")) == F.col("d")), "left").select("page_id", "url", "html", "refers_to")
    return materialize(arrow_map(marked, _write(folder), "path string, records long"), "archives")


_READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _id_of(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") else None


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _READ.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, at = _file_system(path)
                rows = []
                with files.open_input_stream(at, compression=None) as stream:
                    for head, block in open_archive(stream):
                        kind = head["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{path}: the payload of {head['WARC-Record-ID']} does not match its digest")
                        rows.append((_id_of(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, size, digest, _id_of(head.get("WARC-Refers-To")), payload if with_payload and kind == "response" else None))
                        if len(rows) >= 1000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    return run


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """All page records of the archives in ``manifest`` (column ``path``); payloads are checked against their digests."""
    spread = manifest.select("path").repartition(F.col("path"))
    return arrow_map(spread, _read(with_payload), _READ)
