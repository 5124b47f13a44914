"""Benchmark decontamination by word windows.

The windows of the benchmark are split into blocks of bounded size. Each block is
broadcast, and one pass looks for its windows in all documents. A pass maps words
to numbers, drops every stretch with a word that no window has, compares hashes
of the windows left, and confirms each hit word by word. A benchmark that fits
one block needs one pass, without any shuffle of documents.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.llm.words import NOT_WORD, ascii_words, lower_ascii, packed, split_words, unpacked
from martlens.session import written

WINDOW = 10
BLOCK_WINDOWS = 1_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")

SCAN = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct pairs of a window (words joined by blanks) and the item that has it.

    An item shorter than a window is one window; without words it has none.
    """
    words = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"),
        split_words(lower_ascii(F.col("text")), NOT_WORD).alias("words"),
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))
    return (
        words.select("item_id", "words", F.explode(starts).alias("start"))
        .select(F.array_join(F.slice("words", F.col("start"), size), " ").alias("window"), "item_id")
        .distinct()
    )


class WindowIndex:
    """Windows of one block, ready for scanning."""

    def __init__(self, rows: list[tuple[str, str | None]]) -> None:
        self.numbers: dict[bytes, int] = {}
        self.items: dict[bytes, set] = defaultdict(set)
        by_length = defaultdict(set)
        for window, item in rows:
            ids = [self.numbers.setdefault(w, len(self.numbers)) for w in window.encode().split(b" ")]
            key = np.array(ids, np.int32).tobytes()
            self.items[key].add(item)
            by_length[len(ids)].add(key)
        self.hashes = {
            length: np.unique(_hashes(np.stack([np.frombuffer(k, np.int32) for k in keys]).ravel(),
                                      np.arange(len(keys)) * length, length))
            for length, keys in by_length.items()
        }

    def find(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, set]]:
        """Per text: number of words, mask of hit words, items found."""
        get = self.numbers.get
        ids, counts = [], []
        for text in texts:
            words = ascii_words(text)
            ids += [get(w, -1) for w in words]
            ids.append(-1)  # no window reaches over the end of a text
            counts.append(len(words))
        ids = np.array(ids, np.int32)
        firsts = np.concatenate(([0], np.cumsum(np.array(counts) + 1)))
        hit, found = np.zeros(len(ids) + 1, np.int32), [set() for _ in texts]
        gaps = np.concatenate(([0], np.cumsum(ids < 0)))
        for length, hashes in self.hashes.items():
            if len(ids) < length:
                continue
            at = np.flatnonzero(gaps[length:] == gaps[:-length])
            at = at[np.isin(_hashes(ids, at, length), hashes)]
            for start in at.tolist():
                items = self.items.get(ids[start : start + length].tobytes())
                if items:
                    hit[start] += 1
                    hit[start + length] -= 1
                    found[int(np.searchsorted(firsts, start, "right")) - 1] |= items
        mask = np.cumsum(hit[:-1]) > 0
        return [(n, mask[a : a + n], f) for n, a, f in zip(counts, firsts.tolist(), found)]


def _hashes(ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    value = np.zeros(len(at), np.uint64)
    for offset in range(length):
        value = (value + ids[at + offset].astype(np.uint64) + np.uint64(1)) * _FACTOR
        value ^= value >> np.uint64(29)
    return value


def spans_of(mask: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends (exclusive) of the runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edges[::2].tolist(), edges[1::2].tolist()


def _scanner(broadcast):
    @F.pandas_udf(SCAN)
    def scan(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        rows, step = [], 500
        for first in range(0, len(texts), step):
            part = before.iloc[first : first + step]
            found = broadcast.value.find(texts.iloc[first : first + step].tolist())
            for (n, mask, items), starts, ends, old in zip(found, part.starts, part.ends, part["items"]):
                for a, b in zip(starts, ends):
                    mask[a:b] = True
                rows.append((n, *spans_of(mask), sorted({i for i in items if i is not None} | set(old))))
        return pd.DataFrame(rows, columns=SCAN.names)

    return scan


def scan(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """``docs`` with a struct column ``scan``: words, hit word spans, items found.

    Every word inside any occurrence of a window is hit. A null or wordless text
    has no words and no hits. An item without an id marks words but is not
    counted as an item. Repeated rows stay, each with the same result. Other
    columns of ``docs`` are kept; one called ``scan`` is replaced.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, size)
    blocks = max(1, math.ceil(windows.count() / block_windows))
    block = F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks))
    empty = F.lit(None).cast(SCAN)
    ints, strings = F.array().cast("array<int>"), F.array().cast("array<string>")
    empty = F.struct(F.lit(0).cast("long").alias("n_words"), ints.alias("starts"),
                     ints.alias("ends"), strings.alias("items"))
    result = docs.withColumn("scan", empty)
    for number in range(blocks):
        # Bounded: pairs are distinct, so hashing deals them evenly over the blocks.
        rows = [tuple(r) for r in windows.where(block == number).collect()]
        index = spark.sparkContext.broadcast(WindowIndex(rows))
        result = result.withColumn("scan", _scanner(index)(F.col("text"), F.col("scan")))
        if number + 1 < blocks:
            result = written(result)  # one block in memory at a time
    return result


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with the columns of ``docs``."""
    scanned = scan(packed(docs, F.col("text").alias("text")), benchmark, **options)
    return unpacked(scanned.where(F.size("scan.starts") == 0), docs.columns)


@F.pandas_udf(T.StringType())
def _without_spans(texts: pd.Series, scans: pd.DataFrame) -> pd.Series:
    out = []
    for text, starts, ends in zip(texts, scans.starts, scans.ends):
        if text is not None and len(starts):
            words = [m.span() for m in _WORD.finditer(text)]
            keep, last = [], 0
            for a, b in zip(starts, ends):
                keep.append(text[last : words[a][0]])
                last = words[b - 1][1]
            text = "".join(keep) + text[last:]
        out.append(text)
    return pd.Series(out, dtype=object)


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """All documents, with the hit passages cut out of their texts."""
    scanned = scan(packed(docs, F.col("text").alias("text")), benchmark, **options)
    cut = F.col("row").withField("text", _without_spans("text", "scan"))
    return unpacked(scanned.withColumn("row", cut), docs.columns)
