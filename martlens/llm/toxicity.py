"""Toxicity by positive-unlabelled learning with a non-negative risk estimate.

Only confirmed toxic texts and texts without any label are learned from. Spark
counts letter 6-grams in both and keeps those that confirmed toxic texts have
significantly more often; a linear numpy model over these is then fitted with

    risk = prior * R(positive, +1) + max(0, R(unlabelled, -1) - prior * R(positive, -1))

where ``prior`` is the share of toxic texts, estimated from the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.llm.words import letters_only
from martlens.session import written

GRAM = 6
BIN_BITS = 22
# Bounds of the samples the classifier is fitted on (in expectation).
POSITIVE_TEXTS = 4_000
UNLABELLED_TEXTS = 12_000
FEATURES = 768
FEW_OPEN = 10  # labelled documents to an unlabelled one, beyond which those are too few
MIN_Z = 5.0
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_PART_BYTES = 1_000_000


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are not learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def bins_of(cleaned: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash bin of every 6-gram and, for each, the index of its text."""
    pad = b"\0" * (GRAM - 1)
    data = np.frombuffer(pad.join(cleaned) + pad, np.uint8).astype(np.uint64)
    n = len(data) - GRAM + 1
    packed, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for offset in range(GRAM):
        part = data[offset : offset + n]
        packed = packed << np.uint64(8) | part
        whole &= part != 0
    owner = np.repeat(np.arange(len(cleaned)), np.array([len(c) + GRAM - 1 for c in cleaned]))[:n]
    bins = (packed[whole] * _FACTOR) >> np.uint64(64 - BIN_BITS)
    return bins.astype(np.int64), owner[whole]


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


class LinearModel:
    """Weights of the chosen bins and a bias; a text's value counts occurrences."""

    def __init__(self, bins: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.bins, self.weights, self.bias = bins, weights, bias

    def table(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = np.zeros(1 << BIN_BITS, np.float32)
            self._table[self.bins] = self.weights
        return self._table

    def __getstate__(self) -> dict:
        return {"bins": self.bins, "weights": self.weights, "bias": self.bias}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        values = np.zeros(len(texts))
        table = self.table()
        for first, cleaned in parts(texts):
            bins, owner = bins_of(cleaned)
            values[first : first + len(cleaned)] = np.bincount(
                owner, table[bins], minlength=len(cleaned)
            )
        return 1 / (1 + np.exp(-np.clip(values + self.bias, -30, 30)))


def fit_nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float,
              steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Minimise the non-negative risk with the sigmoid loss, by Adam on all rows.

    While the estimated risk of negatives is below zero, the step goes the other
    way for that part alone, so that the fit can't gain from overfitting it.
    """
    width = positive.shape[1]
    theta = np.zeros(width + 1)
    theta[-1] = -1.0
    ones = (np.ones((len(positive), 1)), np.ones((len(unlabelled), 1)))
    p, u = np.hstack([positive, ones[0]]), np.hstack([unlabelled, ones[1]])
    m = v = np.zeros_like(theta)

    def loss(x: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
        value = 1 / (1 + np.exp(np.clip(sign * (x @ theta), -30, 30)))
        slope = -sign * value * (1 - value)
        return float(value.mean()), x.T @ slope / len(x)

    for step in range(1, steps + 1):
        (_, gp), (rn, gn), (ru, gu) = loss(p, 1), loss(p, -1), loss(u, -1)
        gradient = prior * gp + (gu - prior * gn) if ru - prior * rn >= 0 else prior * gn - gu
        gradient = gradient + decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _bin_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        positive = np.array(batch.column("positive").to_pylist(), bool)
        for first, cleaned in parts(batch.column("text").to_pylist()):
            bins, owner = bins_of(cleaned)
            pairs = np.unique(owner << BIN_BITS | bins)
            is_positive = positive[first + (pairs >> BIN_BITS)]
            keys, inverse = np.unique(pairs & ((1 << BIN_BITS) - 1), return_inverse=True)
            hits = np.bincount(inverse, is_positive, minlength=len(keys)).astype(np.int64)
            every = np.bincount(inverse, minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(hits), pa.array(every - hits)], names=["bin", "p", "u"]
            )


def training_texts(docs: DataFrame, labels: DataFrame,
                   positive_texts: int = POSITIVE_TEXTS,
                   unlabelled_texts: int = UNLABELLED_TEXTS) -> tuple[DataFrame, float]:
    """Bounded sample (text, positive) outside the held-out fold, and the prior.

    A document with several labels is toxic if one of them says so. Where nearly all
    documents are labelled, unlabelled texts are drawn from all of them, whatever
    their label: the risk takes them as a mixture with the prior's share of toxic ones.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    learned = known.where(~held_out(F.col("doc_id")))
    n, n_toxic = learned.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n_known = known.count()
    prior = min(0.95, max(1e-4, n_toxic / n)) if n else 1e-4

    def drawn(rate: float) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000

    open_docs = docs.select("doc_id", "text").where(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    n_docs = docs.count()
    toxic_rate = min(1.0, positive_texts / max(1, n_toxic))
    few_open = (n_docs - n_known) * FEW_OPEN < n_known
    open_rate = min(1.0, unlabelled_texts / max(1, n_docs if few_open else n_docs - n))
    toxic = learned.where((F.col("toxic") == 1) & drawn(toxic_rate)).select("doc_id")
    # Both sides are narrowed to the drawn ids before the join, so that only
    # texts of the sample are shuffled.
    positive = open_docs.where(drawn(toxic_rate)).join(F.broadcast(toxic), "doc_id", "left_semi")
    unlabelled = open_docs.where(drawn(open_rate))
    if not few_open:
        unlabelled = unlabelled.join(
            known.where(drawn(open_rate)).select("doc_id"), "doc_id", "left_anti"
        )
    sample = positive.select("text", F.lit(True).alias("positive")).unionByName(
        unlabelled.select("text", F.lit(False).alias("positive"))
    )
    return sample, prior


def fit(docs: DataFrame, labels: DataFrame, features: int = FEATURES, min_z: float = MIN_Z,
        **bounds: int) -> LinearModel:
    """Choose features on the sample with Spark, then fit the risk in numpy."""
    sample, prior = training_texts(docs, labels, **bounds)
    sample = written(sample)
    sizes = dict(sample.groupBy("positive").count().collect())
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    empty = LinearModel(np.array([], np.int64), np.array([]), float(np.log(prior / (1 - prior))))
    if not n_p or not n_u:
        return empty
    share_p, share_u = F.col("p") / n_p, F.col("u") / n_u
    both = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (share_p - share_u) / F.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
    chosen = (
        sample.mapInArrow(_bin_counts, "bin long, p long, u long")
        .groupBy("bin").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
        .where(F.col("p") >= 3)
        .select("bin", z.alias("z")).where(F.col("z") >= min_z)
        .orderBy(F.desc("z"), "bin").limit(features)
    )
    bins = np.sort(np.array([r.bin for r in chosen.collect()], np.int64))
    if not len(bins):
        return empty

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BIN_BITS, -1, np.int64)
        place[bins] = np.arange(len(bins))
        for batch in batches:
            rows = np.zeros((batch.num_rows, len(bins)), np.uint32)
            for first, cleaned in parts(batch.column("text").to_pylist()):
                found, owner = bins_of(cleaned)
                at = place[found]
                np.add.at(rows, (first + owner[at >= 0], at[at >= 0]), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("positive"), pa.array([r.tobytes() for r in rows], pa.binary())],
                names=["positive", "counts"],
            )

    table = sample.mapInArrow(vectors, "positive boolean, counts binary").toArrow()
    x = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint32).reshape(-1, len(bins))
    positive = np.array(table["positive"].to_pylist(), bool)
    weights, bias = fit_nn_pu(x[positive].astype(float), x[~positive].astype(float), prior)
    return LinearModel(bins, weights, bias)


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted``.

    Null and empty texts get the score of a text without any evidence. Without a
    confirmed toxic text, every score is the smallest prior. Repeated rows get
    equal scores. Columns of ``docs`` with these three names are replaced.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    @F.pandas_udf("double")
    def value(texts: pd.Series) -> pd.Series:
        return pd.Series(broadcast.value.scores(texts.tolist()))

    return (
        docs.withColumn("held_out", held_out(F.col("doc_id")))
        .withColumn("score", value(F.col("text")))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )
