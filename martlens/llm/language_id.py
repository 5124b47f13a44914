"""Language identification with bit-sliced Bloom filters of letter 4-grams.

One table serves all languages: a slot holds one bit per language, so the AND of
the slots of an n-gram is the set of languages whose filter contains it. A text
is decided by the counts of these bits, each corrected for the false positives
that the fill of its filter lets expect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.llm.words import letters_only, packed, unpacked

GRAM = 4
SLOT_BITS = 20
HASHES = 3
# N-grams in fewer texts of a language than this share don't enter its filter.
MIN_SHARE = 0.02
# Bound of the sample of labelled texts, for each language (in expectation).
TEXTS_PER_LANGUAGE = 8_000
# A language is told if its filter has this share of all n-grams of a text, and
# the count is above the next one's and above zero by so many standard deviations
# of the false positives.
MIN_COVERAGE = 0.4
NOISE_SD = 4
UNKNOWN = "und"
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_LETTER = regex.compile(r"\p{L}")
_PART_BYTES = 1_000_000


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def grams_of(cleaned: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All 4-grams (packed into integers) and, for each, the index of its text."""
    data = np.frombuffer(b"\0\0\0".join(cleaned) + b"\0\0\0", np.uint8).astype(np.uint32)
    packed = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24
    owner = np.repeat(np.arange(len(cleaned)), np.array([len(c) + 3 for c in cleaned]))[:-3]
    whole = data[3:] != 0
    for offset in (0, 1, 2):
        whole &= data[offset : offset - 3] != 0
    return packed[whole], owner[whole]


def parts(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Cleaned texts in runs of bounded size, each with the index of its first."""
    first, run, size = 0, [], 0
    for index, text in enumerate(texts):
        run.append(letters_only(text or ""))
        size += len(run[-1])
        if size >= _PART_BYTES:
            yield first, run
            first, run, size = index + 1, [], 0
    if run:
        yield first, run


class BitSlicedFilter:
    """Bloom filters of all languages in one table, 64 languages to a plane."""

    def __init__(self, languages: list[str], grams: np.ndarray, owners: np.ndarray,
                 prior: str = UNKNOWN) -> None:
        self.languages, self.prior = languages, prior
        width = np.uint8 if len(languages) <= 8 else np.uint64
        self.per_plane = 8 * np.dtype(width).itemsize
        planes = max(1, -(-len(languages) // self.per_plane))
        self.planes = np.zeros((planes, 1 << SLOT_BITS), width)
        slots = self._slots(grams)
        for number in range(len(languages)):
            plane, bit = divmod(number, self.per_plane)
            for slot in slots:
                self.planes[plane, slot[owners == number]] |= width(1 << bit)
        fill = [
            np.mean((self.planes[n // self.per_plane] >> width(n % self.per_plane)) & width(1))
            for n in range(len(languages))
        ]
        self.false_rate = np.minimum(np.array(fill) ** HASHES, 0.999)

    @staticmethod
    def _slots(grams: np.ndarray) -> list[np.ndarray]:
        wide = grams.astype(np.uint64)
        return [(wide * np.uint64(f)) >> np.uint64(64 - SLOT_BITS) for f in _FACTORS[:HASHES]]

    def counts(self, cleaned: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each text, and how many of them each language's filter has."""
        grams, owner = grams_of(cleaned)
        total = np.bincount(owner, minlength=len(cleaned))
        slots = self._slots(grams)
        found = np.zeros((len(cleaned), len(self.languages)))
        for plane, table in enumerate(self.planes):
            masks = table[slots[0]]
            for slot in slots[1:]:
                masks &= table[slot]
            first = plane * self.per_plane
            for number in range(first, min(first + self.per_plane, len(self.languages))):
                bit = (masks >> masks.dtype.type(number - first)) & masks.dtype.type(1)
                found[:, number] = np.bincount(owner, bit, minlength=len(cleaned))
        return total, found

    def decide(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score: the best corrected count over the sum of the best two."""
        return [(language, score) for language, score, _ in self.judge(texts)]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score, and whether the evidence is enough to tell the language.

        The score only compares two languages: it is 0.5 or more for any text with
        evidence. So the best corrected count is also held against all n-grams of
        the text and against the noise of false positives.
        """
        out = []
        for first, cleaned in parts(texts):
            total, found = self.counts(cleaned)
            true = (found - total[:, None] * self.false_rate) / (1 - self.false_rate)
            true = np.clip(true, 0, None)
            noise = total[:, None] * self.false_rate / (1 - self.false_rate)  # variances
            for row, values in enumerate(true):
                text = texts[first + row]
                if not text or not self.languages or not _LETTER.search(text):
                    out.append((UNKNOWN, 0.0, False))
                elif not values.any():
                    out.append((self.prior, 0.0, False))
                else:
                    best = int(values.argmax())
                    others = np.delete(values, best)
                    second = others.max() if len(others) else 0.0
                    margin = values[best] - second
                    deviation = np.sqrt(noise[row, best] + np.delete(noise[row], best).max(initial=0.0))
                    told = margin > NOISE_SD * deviation and values[best] >= MIN_COVERAGE * total[row]
                    score = float(values[best] / (values[best] + second))
                    out.append((self.languages[best], score, bool(told)))
        return out


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each language hold each n-gram, added up per run of texts."""
    for batch in batches:
        languages = batch.column("lang").to_pylist()
        for first, cleaned in parts(batch.column("text").to_pylist()):
            grams, owner = grams_of(cleaned)
            pairs = np.unique(owner.astype(np.uint64) << np.uint64(32) | grams)
            names = np.array(languages[first : first + len(cleaned)], object)
            kinds, numbers = np.unique(names, return_inverse=True)
            owner = (pairs >> np.uint64(32)).astype(np.int64)
            keys, texts = np.unique(
                numbers[owner].astype(np.uint64) << np.uint64(32) | pairs & np.uint64(0xFFFFFFFF),
                return_counts=True,
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds[(keys >> np.uint64(32)).astype(np.int64)].tolist(), pa.string()),
                 pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                 pa.array(texts.astype(np.int64))],
                names=["lang", "gram", "texts"],
            )


def fit(docs: DataFrame, texts_per_language: int = TEXTS_PER_LANGUAGE,
        min_share: float = MIN_SHARE) -> BitSlicedFilter:
    """Learn the filters from the text and language of a sample of ``docs``.

    Rows with a null text or language, or with a null id, are not learned from.
    The sample is drawn by a hash of the id. What reaches the driver is bounded:
    a language has at most (n-grams of a mean text / ``min_share``) n-grams.
    """
    usable = docs.where("doc_id is not null and text is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return BitSlicedFilter([], np.array([], np.int64), np.array([], np.int64))
    rates = F.create_map(*[
        F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, texts_per_language / n))
    ])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rates[F.col("lang")] * 1_000_000
    sample = usable.select("doc_id", "lang", "text").where(draw)
    counts = (
        sample.select("lang", "text")
        .mapInArrow(_document_counts, "lang string, gram long, texts long")
        .groupBy("lang", "gram").agg(F.sum("texts").alias("texts"))
    )
    floor = F.create_map(*[
        F.lit(x) for name, n in sizes.items()
        for x in (name, min_share * min(n, texts_per_language))
    ])
    rows = counts.where(F.col("texts") >= floor[F.col("lang")]).select("lang", "gram").toArrow()
    languages = sorted(sizes)
    owners = pc.index_in(rows["lang"].combine_chunks(), pa.array(languages, pa.string()))
    prior = max(languages, key=lambda name: (sizes[name], name))
    return BitSlicedFilter(languages, rows["gram"].to_numpy(), np.asarray(owners), prior)


def predictor(docs: DataFrame, model: BitSlicedFilter):
    """Column function: text -> struct(lang_pred, score, told)."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, told boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(broadcast.value.judge(texts.tolist()), columns=["lang_pred", "score", "told"])

    return predict


def identify(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score`` (0 to 1).

    The filters are fitted on documents that are not held out. Null texts and
    texts without a letter are ``und`` with score 0; a text whose letters no
    language knows gets the commonest language with score 0. Without anything to
    learn from, all texts are ``und``. Repeated rows get equal results. Columns
    of ``docs`` with these three names are replaced.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))), **options)
    guess = predictor(docs, model)(F.col("text"))
    return (
        docs.withColumn("held_out", held_out(F.col("doc_id")))
        .withColumn("_guess", guess)
        .withColumn("lang_pred", F.col("_guess.lang_pred"))
        .withColumn("score", F.col("_guess.score"))
        .drop("_guess")
    )


def keep_identified(docs: DataFrame, min_score: float = 0.5, **options) -> DataFrame:
    """Documents in a learned language that can be told; the rest is rejected.

    Rejected are texts with a score below ``min_score``, and those without enough
    evidence for one language: in other languages, gibberish, or even mixtures.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))), **options)
    guess = predictor(docs, model)(F.col("text"))
    kept = packed(docs, guess.alias("guess")).where(
        (F.col("guess.lang_pred") != UNKNOWN) & (F.col("guess.score") >= min_score)
        & F.col("guess.told")
    )
    return unpacked(kept, docs.columns)
