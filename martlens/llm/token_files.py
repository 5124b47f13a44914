"""Files of token ids: written in ascending document order, and read back.

A file holds coded blocks, then a table of documents (id and number of ids) and
a footer with its size. Files of a task follow each other, tasks follow the range
partitioning of the ids, so a file's place is known from the index alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlens.llm.files import new_folder, open_input, open_output
from martlens.llm.pieces import encoder
from martlens.llm.range_coder import HEAD, decode_blocks, encode_blocks
from martlens.session import written

END_ID = 2
# Ids after which a task begins a new file; it ends with a whole document.
FILE_IDS = 8_000_000
MAGIC = b"TOKIDS02"
_FOOT = struct.Struct("<QQQQ")  # blocks, documents, bytes of the table, documents without id (the first ones)

FILES = "path string, part int, number int, n_ids long, n_docs long"
TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def write_file(sink, doc_ids: list[int | None], ids: list[bytes]) -> int:
    """Write documents with their ids (32-bit integers); returns the number of ids.

    Documents without an id come first.
    """
    stream = np.frombuffer(b"".join(ids), "<u4")
    blocks = encode_blocks(stream)
    sink.write(MAGIC)
    for block in blocks:
        sink.write(block)
    table = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    table += np.array([len(i) // 4 for i in ids], "<u8").tobytes()
    table = zlib.compress(table)
    sink.write(table)
    sink.write(_FOOT.pack(len(blocks), len(doc_ids), len(table), doc_ids.count(None)))
    sink.close()
    return len(stream)


def read_file(source) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, numbers of ids, and all ids of a file."""
    data = source.readall()
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of token ids")
    n_blocks, n_docs, n_table, n_nulls = _FOOT.unpack_from(data, len(data) - _FOOT.size)
    table = zlib.decompress(data[len(data) - _FOOT.size - n_table : len(data) - _FOOT.size])
    docs = [None] * n_nulls + np.frombuffer(table, "<i8", n_docs)[n_nulls:].tolist()
    sizes = np.frombuffer(table, "<u8", n_docs, 8 * n_docs).astype(np.int64)
    blocks, at = [], len(MAGIC)
    for _ in range(n_blocks):
        end = at + HEAD.size + HEAD.unpack_from(data, at)[1]
        blocks.append(data[at:end])
        at = end
    return docs, sizes, decode_blocks(blocks)


def write_tokens(docs: DataFrame, vocabulary: str, folder: str | None = None,
                 file_ids: int = FILE_IDS, end_id: int = END_ID) -> DataFrame:
    """Encode all texts and write their ids; returns the table of files.

    Documents are in ascending order of doc_id (null first, ties by text), each
    followed by ``end_id``. A null text is empty. A task holds the ids of one
    file at a time.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        part, number, size = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        ids: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal number, size, names, ids
            sink, path = open_output(folder, f"ids-{part}-{number}")
            n = write_file(sink, names, ids)
            row = ([path], [part], [number], [n], [len(names)])
            number, size, names, ids = number + 1, 0, [], []
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(row, kinds)],
                names=["path", "part", "number", "n_ids", "n_docs"],
            )

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                names.append(doc)
                ids.append(pieces.encode(text.as_py() or "") + end)
                size += len(ids[-1]) // 4
                if size >= file_ids:
                    yield close()
        if names:
            yield close()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id")
    return written(ordered.sortWithinPartitions("doc_id", "text").mapInArrow(write, FILES))


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 and, if asked, ids.

    ``start`` counts the ids of all documents before it. Only the table of files,
    a row for each, is summed in order; its length is the number of files.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin in zip(batch.column("path").to_pylist(), batch.column("begin").to_pylist()):
                docs, sizes, ids = read_file(open_input(path))
                ends = np.cumsum(sizes)
                for first in range(0, len(docs), 2000):
                    cut = slice(first, first + 2000)
                    parts = [ids[e - n : e].tobytes() for e, n in zip(ends[cut], sizes[cut])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[cut], pa.int64()),
                         pa.array(begin + ends[cut] - sizes[cut]), pa.array(sizes[cut]),
                         pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                         pa.array(parts if with_ids else [None] * len(parts), pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))
    placed = files.withColumn("begin", begin).select("path", "begin")
    count = max(1, files.count())
    rows = placed.repartitionByRange(count, "begin").mapInArrow(
        read, TOKENS
    )
    return rows if with_ids else rows.drop("ids")
