"""WARC archives in seekable Zstandard bundles.

Each task writes its records into a bundle: records are grouped into independent
frames, and a seek table in a skippable frame at the end lists the sizes of all
frames. The tasks return, for every record, its bundle, frame and offset within
the frame, so that one record is read by decompressing one frame.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.llm.files import new_folder, open_input, open_output
from martlens.session import written

# Payloads below this size are never revisits.
MIN_REVISIT_BYTES = 100
FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 512 * 1024 * 1024
# Records that a task reads back, before compression.
READ_BYTES = 32 * 1024 * 1024
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the seekable Zstandard format and of the WARC format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WARC_VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, bundle string, frame int, frame_offset int, record_bytes int"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, " \
    "record_type string, refers_to long, payload binary"


class BundleWriter:
    """A seekable Zstandard file; ``add`` returns a record's frame and offset."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> None:
        self.sink, self.frame_bytes = sink, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.parts: list[bytes] = []
        self.size = self.written = 0
        self.table: list[tuple[int, int, int]] = []

    def add(self, record: bytes) -> tuple[int, int]:
        if self.size and self.size + len(record) > self.frame_bytes:
            self._flush()
        place = len(self.table), self.size
        self.parts.append(record)
        self.size += len(record)
        return place

    def _flush(self) -> None:
        data = b"".join(self.parts)
        frame = self.compressor.compress(data)
        # The format's checksum is the low half of XXH64; the record digests
        # cover the payloads, so the table carries sizes only.
        self.table.append((len(frame), len(data), 0))
        self.sink.write(frame)
        self.written += len(frame)
        self.parts, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._flush()
        body = b"".join(struct.pack("<II", a, b) for a, b, _ in self.table)
        body += struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.sink.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, source) -> None:
        self.source = source
        end = source.size()
        count, descriptor, magic = struct.unpack("<IBI", source.read_at(9, end - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("not a seekable Zstandard file")
        entry = 12 if descriptor & 0x80 else 8
        table = source.read_at(count * entry, end - 9 - count * entry)
        self.frames, at = [], 0
        for number in range(count):
            size, plain = struct.unpack_from("<II", table, number * entry)
            self.frames.append((at, size, plain))
            at += size

    def frame(self, number: int) -> bytes:
        at, size, plain = self.frames[number]
        data = zstandard.ZstdDecompressor().decompress(self.source.read_at(size, at), plain)
        if len(data) != plain:
            raise ValueError(f"frame {number} has {len(data)} bytes, not {plain}")
        return data


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str,
                refers_to: int | None) -> bytes:
    """A response record, or a revisit if ``refers_to`` is given.

    A revisit's block holds the HTTP header alone, with the payload's full length.
    """
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
    block = http % len(payload) + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if revisit:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields).encode()
    return b"%b\r\n%b\r\n%b\r\n\r\n" % (WARC_VERSION, head, block)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].split(b"\r\n")
        if version != WARC_VERSION:
            raise ValueError(f"no record at {at}")
        fields = dict(line.decode().split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _page_of(urn: str | None) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">") if urn else ""
    return int(number) if number else None


def _read_record(fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(head.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return (_page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest,
            fields["WARC-Type"], _page_of(fields.get("WARC-Refers-To")), payload)


def plan_records(pages: DataFrame) -> DataFrame:
    """Pages with ``payload``, ``digest`` and ``refers_to`` (null: a response).

    Of equal payloads of at least 100 bytes, the smallest page_id is the
    response. Rows that repeat that id are responses too. A null id is never
    referred to, so without any id all copies are responses.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    # Only payloads that are repeated take part in the join; counting them
    # moves digests and ids, combined before the shuffle.
    first = (
        keyed.where(F.length("payload") >= MIN_REVISIT_BYTES)
        .groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
        .select(F.col("digest").alias("f_digest"), "first")
    )
    joined = keyed.join(first, F.col("digest") == F.col("f_digest"), "left")
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES,
                   bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write all pages; returns the index, one row per record.

    Bundles are rolled at ``bundle_bytes``; frames close before they exceed
    ``frame_bytes``, and a larger record has a frame of its own. The index is a
    written table and lists only files of tasks that succeeded.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = path = None
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch.column(n) for n in ("page_id", "url", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page, url, payload, digest, refers = (c[i].as_py() for c in columns)
                if bundle is None:
                    sink, path = open_output(folder, "bundle")
                    bundle = BundleWriter(sink, frame_bytes)
                record = warc_record(page, url, payload, digest, refers)
                rows.append((page, path, *bundle.add(record), len(record)))
                if bundle.written >= bundle_bytes:
                    bundle.close()
                    bundle = None
            names = ("page_id", "bundle", "frame", "frame_offset", "record_bytes")
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            cells = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=list(names))
        if bundle is not None:
            bundle.close()

    return written(plan_records(pages).mapInArrow(write, INDEX))


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the bundles in an index, read frame by frame.

    The unit of work is a frame, so one large bundle is read by many tasks. Their
    number follows the bytes of the records; tasks get neighbouring frames, and so
    read the seek table of a bundle once.
    """
    size = index.agg(F.sum(F.col("record_bytes").cast("long"))).first()[0] or 0
    tasks = max(1, math.ceil(size / READ_BYTES))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, BundleReader] = {}
        for batch in batches:
            for path, number in zip(batch.column("bundle").to_pylist(), batch.column("frame").to_pylist()):
                if path not in readers:
                    readers = {path: BundleReader(open_input(path))}
                rows = [_read_record(*r) for r in parse_records(readers[path].frame(number))]
                if not payloads:
                    rows = [(*r[:-1], None) for r in rows]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    frames = index.select("bundle", "frame").distinct()
    dealt = frames.repartitionByRange(tasks, "bundle", "frame")
    return dealt.sortWithinPartitions("bundle", "frame").mapInArrow(read, RECORDS)


def read_record(index: DataFrame, page_id: int) -> list[tuple]:
    """The records of one page, by seeking to their frames."""
    out = []
    for row in index.where(F.col("page_id") == page_id).collect():
        data = BundleReader(open_input(row.bundle)).frame(row.frame)
        part = data[row.frame_offset : row.frame_offset + row.record_bytes]
        out += [_read_record(*r) for r in parse_records(part)]
    return out


def archive(pages: DataFrame) -> DataFrame:
    """Write pages into archives in the shared folder and return their index."""
    return write_archives(pages, new_folder(pages.sparkSession, "warc"))
