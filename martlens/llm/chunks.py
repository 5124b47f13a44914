"""BPE encoding with reuse of content-defined chunks.

A rolling hash over the bytes decides where a text is cut, so passages shared by
documents fall into equal chunks wherever they stand. Chunks are counted over all
documents; those whose reuse saves most are encoded once for the whole job, up to
a bounded table that is broadcast. What lies between shared chunks is encoded in one
go. Where both meet, the join is repaired: a stretch around it is encoded anew and
widened until its first and its last words have the ids that both sides gave them.
Results never depend on what is reused.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.llm.pieces import PieceEncoder, encoder

WINDOW = 32
MEAN_BITS = 9  # a cut every 512 bytes on average, after the least size
MIN_BYTES, MAX_BYTES = 128, 4096
# Bound of the broadcast table: entries, each of at most MAX_BYTES bytes of text.
SHARED_CHUNKS = 32_768
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BLANKS = frozenset(b"\t\n\x0b\x0c\r ")


def cuts(data: bytes) -> list[int]:
    """Chunk borders of a text's UTF-8 bytes, from 0 to its length.

    A border stands where the hash of the last 32 bytes has its top bits zero,
    at least 128 and at most 4,096 bytes after the one before, moved on to the
    start of a character.
    """
    n = len(data)
    if n <= MIN_BYTES:
        return [0, n] if n else [0]
    raw = np.frombuffer(data, np.uint8)
    mixed = (raw.astype(np.uint64) + np.uint64(1)) * _FACTOR
    mixed ^= mixed >> np.uint64(31)
    # Polynomial hash of each window, built by doubling its width.
    value, width = mixed, 1
    while width < WINDOW:
        step = np.uint64(pow(0x9E3779B97F4A7C15, width, 1 << 64))
        value = value[:-width] * step + value[width:]
        width *= 2
    picked = np.flatnonzero((value * _FACTOR) >> np.uint64(64 - MEAN_BITS) == 0) + WINDOW
    borders, last = [0], 0
    for place in picked.tolist() + [n]:
        while place - last > MAX_BYTES:
            last = _at_character(data, last + MAX_BYTES)
            borders.append(last)
        if place - last >= MIN_BYTES and place < n:
            place = _at_character(data, place)
            if place < n:
                borders.append(place)
                last = place
    return borders + [n]


def _at_character(data: bytes, place: int) -> int:
    while place < len(data) and data[place] & 0xC0 == 0x80:
        place += 1
    return place


def _always_breaks(data: bytes, place: int) -> bool:
    """A single blank between two ASCII characters that are not white space."""
    before, after = data[place - 1], data[place + 1] if place + 1 < len(data) else 32
    return data[place] == 32 and before < 128 > after and before not in _BLANKS and after not in _BLANKS


def break_before(data: bytes, place: int) -> int:
    """The last place up to ``place`` at which a tokenizer breaks between words, or 0."""
    while place > 0 and not (place < len(data) and _always_breaks(data, place)):
        place = max(data.rfind(b" ", 0, place), 0)
    return place


def break_after(data: bytes, place: int) -> int:
    """The first place from ``place`` on at which it breaks, or the end."""
    while place < len(data) and not (place > 0 and _always_breaks(data, place)):
        place = data.find(b" ", place + 1)
        place = len(data) if place < 0 else place
    return place


class _Segment:
    """Ids of a stretch of a text, with the places where they end."""

    def __init__(self, start: int, ids: bytes, lengths: np.ndarray) -> None:
        self.ids = np.frombuffer(ids, "<u4")
        self.ends = start + np.cumsum(lengths[self.ids])
        self.start, self.end = start, int(self.ends[-1])

    def between(self, low: int, high: int) -> np.ndarray | None:
        """The ids from one place to another, if ids end at both."""
        a = 0 if low == self.start else int(np.searchsorted(self.ends, low)) + 1
        b = int(np.searchsorted(self.ends, high)) + 1 if high > self.start else 0
        exact = (low == self.start or self.ends[a - 1 : a].tolist() == [low]) and (
            high == self.start or self.ends[b - 1 : b].tolist() == [high]
        )
        return self.ids[a:b] if exact else None


class ChunkEncoder:
    """Encodes texts; ``shared`` maps digests of chunks to their ids."""

    def __init__(self, pieces: PieceEncoder, shared: dict[bytes, bytes] | None = None) -> None:
        self.pieces, self.shared = pieces, shared or {}

    def encode(self, text: str) -> bytes:
        """Ids of a text, as 32-bit integers, equal to those of the library.

        If a join finds no agreement within the segments beside it, the whole text
        is encoded anew.
        """
        if not (text and self.shared and self.pieces.breaks) or self.pieces.has_special(text):
            return self.pieces.encode(text)
        data = text.encode()
        borders = cuts(data)
        known = [self.shared.get(chunk_key(data[a:b])) for a, b in zip(borders, borders[1:])]
        if not any(known):
            return self.pieces.encode(text)
        segments, at = [], 0
        for place, ids in enumerate(known):
            if ids is not None:
                if at < borders[place]:
                    segments.append(self._encoded(data, at, borders[place]))
                at = borders[place + 1]
                segments.append(_Segment(borders[place], ids, self.pieces.lengths))
        if at < len(data):
            segments.append(self._encoded(data, at, len(data)))
        out, at = [], 0
        for left, right in zip(segments, segments[1:]):
            repaired = self._repaired(data, left, right, at)
            if repaired is None:
                return self.pieces.encode(text)
            kept, new, at = repaired
            out += [kept, new]
        rest = segments[-1].between(at, len(data))
        if rest is None:
            return self.pieces.encode(text)
        return b"".join(part.tobytes() for part in [*out, rest])

    def _encoded(self, data: bytes, low: int, high: int) -> _Segment:
        return _Segment(low, self.pieces.encode(data[low:high].decode()), self.pieces.lengths)

    def _repaired(
        self, data: bytes, left: _Segment, right: _Segment, at: int
    ) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Ids of the left side from ``at`` on, ids around the join, and where they end.

        The stretch has a word on either side of the part in doubt. Those two words
        must come out with the ids of the segments they are from; else they are in
        doubt too, and the stretch grows by the next.
        """
        join = right.start
        low, high = break_before(data, join), break_after(data, join)
        while True:
            outer_low = break_before(data, low - 1) if low > 0 else 0
            outer_high = break_after(data, high + 1) if high < len(data) else high
            if (outer_low < at and outer_low > 0) or outer_low < left.start or outer_high > right.end:
                return None
            new = self._encoded(data, outer_low, outer_high)
            before, after = left.between(outer_low, low), right.between(high, outer_high)
            same_before, same_after = new.between(outer_low, low), new.between(high, outer_high)
            agrees = not any(p is None for p in (before, after, same_before, same_after)) and (
                np.array_equal(before, same_before) and np.array_equal(after, same_after)
            )
            if agrees:
                kept = left.between(at, outer_low) if at <= outer_low else None
                return None if kept is None else (kept, new.ids, outer_high)
            if outer_low == 0 and outer_high == len(data):
                return None
            low, high = outer_low, outer_high


def chunk_key(part: bytes) -> bytes:
    return xxhash.xxh3_128_digest(part)


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        sizes: dict[bytes, int] = {}
        for text in batch.column("text").to_pylist():
            data = (text or "").encode()
            borders = cuts(data)
            for a, b in zip(borders, borders[1:]):
                key = chunk_key(data[a:b])
                seen[key] += 1
                sizes[key] = b - a
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64()),
             pa.array([sizes[k] for k in seen], pa.int64())],
            names=["key", "n", "bytes"],
        )


def shared_chunks(docs: DataFrame, limit: int = SHARED_CHUNKS) -> DataFrame:
    """Chunks that occur more than once, by what reuse saves: key, n, bytes."""
    counts = (
        docs.select("text").mapInArrow(_count_chunks, "key binary, n long, bytes long")
        .groupBy("key").agg(F.sum("n").alias("n"), F.max("bytes").alias("bytes"))
        .where(F.col("n") > 1)
    )
    saved = (F.col("n") - 1) * F.col("bytes")
    return counts.orderBy(saved.desc(), "key").limit(limit)


def encode_shared(docs: DataFrame, vocabulary: str, limit: int = SHARED_CHUNKS) -> dict[bytes, bytes]:
    """Ids of the shared chunks; each is encoded once, by the executors."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast({bytes(r.key) for r in shared_chunks(docs, limit).collect()})

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            found: dict[bytes, bytes] = {}
            for text in batch.column("text").to_pylist():
                data = (text or "").encode()
                borders = cuts(data)
                for a, b in zip(borders, borders[1:]):
                    key = chunk_key(data[a:b])
                    if key in wanted.value and key not in done:
                        done.add(key)
                        found[key] = data[a:b]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())],
                names=["key", "chunk"],
            )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(vocabulary)
        for batch in batches:
            ids = [pieces.encode(c.decode()) for c in batch.column("chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(ids, pa.binary())], names=["key", "ids"]
            )

    once = (
        docs.select("text").mapInArrow(texts, "key binary, chunk binary")
        .groupBy("key").agg(F.min("chunk").alias("chunk"))
        .mapInArrow(encode, "key binary, ids binary")
    )
    table = once.toArrow()
    return dict(zip(table["key"].to_pylist(), table["ids"].to_pylist()))


def encode_documents(docs: DataFrame, vocabulary: str, limit: int = SHARED_CHUNKS) -> DataFrame:
    """One row per document row: doc_id, ids (32-bit little-endian integers), decoded.

    A null text is empty, and an empty text has no ids and decodes to ''.
    Repeated rows get equal results. Only doc_id and text of ``docs`` are used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(encode_shared(docs, vocabulary, limit))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(vocabulary)
        chunked = ChunkEncoder(pieces, shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                ids = [chunked.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.binary()),
                     pa.array([pieces.decode(i) for i in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of ids and decoded text."""
    return encoded.select(
        "doc_id",
        F.floor(F.length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
