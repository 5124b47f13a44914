"""Exact k-means in whole numbers, with Ptolemaic lower bounds from pivots.

For a vector q, a centroid o and pivots p, s, Ptolemy's inequality gives

    d(q, o) * d(p, s) >= |d(q, p) * d(o, s) - d(q, s) * d(o, p)|.

The pivots are fixed, so the distances of a vector to them are worked out once and
stored beside it; those of the few centroids are worked out once a round. A centroid
is left out for a vector only if its bound, less what rounding may have added, lies
above an exact distance already known. All others are measured in 64-bit integers.

Vectors stay where they are: a round is one pass that leaves a row of sums for each
centroid and task, and only the sums of all tasks, a row a centroid, reach the
driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.session import written

SIZE, SCALE = 64, 256
CENTROIDS, ROUNDS = 40, 5
PIVOTS = 8
# Largest whole number of a component: squared distances then fit 64 bits.
BOUND = 2**27
_EPS = 2.0**-53
_ROWS = 2_048


def whole_vectors(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, c) of the vectors with ``SIZE`` finite components, as whole numbers.

    A component x becomes floor(256 * x), kept within plus and minus ``BOUND``.
    """
    def unusable(x: Column) -> Column:
        x = x.cast("double")
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    def whole(x: Column) -> Column:
        scaled = F.lit(float(SCALE)) * x.cast("double")
        return F.floor(F.least(F.greatest(scaled, F.lit(-float(BOUND))), F.lit(float(BOUND)))).cast("int")

    values = F.col(vector)
    return embeddings.where((F.size(values) == SIZE) & ~F.exists(values, unusable)).select(
        "vec_id", F.transform(values, whole).alias("c")
    )


def first_centroids(vectors: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The k vectors of smallest digest; equal ids by their components, null ids last."""
    digest = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(digest.alias("d"), "c").orderBy(F.asc_nulls_last("d"), "c").limit(k)
    return np.array([r.c for r in rows.collect()], np.int64).reshape(-1, SIZE)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers."""
    difference = a - b
    return np.einsum("...i,...i->...", difference, difference)


def choose_pivots(centroids: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Distinct vectors, each the farthest from those before it."""
    chosen = centroids[:1]
    while 0 < len(chosen) < n:
        nearest = squared(centroids[:, None], chosen[None]).min(axis=1)
        if nearest.max() == 0:
            break
        chosen = np.vstack([chosen, centroids[nearest.argmax()]])
    return chosen


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rounded distances of rows to pivots, one pivot at a time."""
    if not len(pivots):
        return np.zeros((len(x), 0))
    return np.sqrt(np.column_stack([squared(x, p) for p in pivots]).astype(np.float64))


def lower_bounds(to_pivots: np.ndarray, centroids_to_pivots: np.ndarray,
                 between: np.ndarray) -> np.ndarray:
    """Squared lower bounds of the distances of vectors and centroids, never too large.

    Each distance is off by at most two units of rounding, and a product of two of
    them and the difference of the products by a few more; sixteen are taken off.
    """
    best = np.zeros((len(to_pivots), len(centroids_to_pivots)))
    for i in range(len(between)):
        for j in range(i + 1, len(between)):
            one = to_pivots[:, i, None] * centroids_to_pivots[None, :, j]
            other = to_pivots[:, j, None] * centroids_to_pivots[None, :, i]
            bound = np.abs(one - other) - 16 * _EPS * (one + other)
            np.maximum(best, bound / (between[i, j] * (1 + 16 * _EPS)), out=best)
    return best * best * (1 - 16 * _EPS)


class Assignment:
    """The nearest centroid of vectors, and how many distances had to be measured."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray) -> None:
        self.centroids = centroids
        self.to_pivots = pivot_distances(centroids, pivots)
        self.between = pivot_distances(pivots, pivots)
        self.measured = 0

    def nearest(self, x: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance; ties to the smaller."""
        bounds = lower_bounds(to_pivots, self.to_pivots, self.between)
        cluster = bounds.argmin(axis=1)
        distance = squared(x, self.centroids[cluster])
        first = cluster.copy()
        # A float of an exact distance may be too small by one unit of rounding.
        limit = distance.astype(np.float64) * (1 + 2 * _EPS)
        survives = bounds <= limit[:, None]
        survives[np.arange(len(x)), first] = False
        self.measured += len(x) + int(survives.sum())
        for number in range(len(self.centroids)):
            rows = np.flatnonzero(survives[:, number])
            found = squared(x[rows], self.centroids[number])
            closer = (found < distance[rows]) | ((found == distance[rows]) & (number < cluster[rows]))
            cluster[rows[closer]], distance[rows[closer]] = number, found[closer]
        return cluster, distance


def _blocks(batch: pa.RecordBatch, n_pivots: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first in range(0, batch.num_rows, _ROWS):
        part = batch.slice(first, _ROWS)
        x = part.column("c").flatten().to_numpy().astype(np.int64).reshape(-1, SIZE)
        d = part.column("d").flatten().to_numpy().reshape(len(x), n_pivots)
        yield first, x, d


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors`` with ``d``, the distances to the pivots."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("c").flatten().to_numpy().astype(np.int64).reshape(-1, SIZE)
            d = pivot_distances(x, pivots)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("c"), pa.array(list(d), pa.list_(pa.float64()))],
                names=["vec_id", "c", "d"],
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(add, f"vec_id {kind}, c array<int>, d array<double>")


_SUMS = [f"s{i}" for i in range(SIZE)]


def cluster_sums(vectors: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(cluster, n, measured, s0, s1, ...): rows, distances measured and sums."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Assignment(centroids, pivots)
        sums = np.zeros((len(centroids), SIZE), np.int64)
        n = np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, x, d in _blocks(batch, len(pivots)):
                cluster, _ = held.nearest(x, d)
                np.add.at(sums, cluster, x)
                n += np.bincount(cluster, minlength=len(n))
        seen = np.flatnonzero(n)
        measured = np.zeros(len(seen), np.int64)
        measured[:1] = held.measured
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int32()), pa.array(n[seen]), pa.array(measured),
             *[pa.array(sums[seen, i]) for i in range(SIZE)]],
            names=["cluster", "n", "measured", *_SUMS],
        )

    schema = "cluster int, n long, measured long, " + ", ".join(f"{s} long" for s in _SUMS)
    partial = vectors.select("c", "d").mapInArrow(add_up, schema)
    return partial.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("n", "measured", *_SUMS)])


def assigned(vectors: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Assignment(centroids, pivots)
        for batch in batches:
            for first, x, d in _blocks(batch, len(pivots)):
                cluster, distance = held.nearest(x, d)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").slice(first, len(x)), pa.array(cluster, pa.int32()),
                     pa.array(distance, pa.int64())],
                    names=["vec_id", "cluster", "distance"],
                )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long")


class Clusters:
    """Final centroids, and for each round rows seen and distances measured."""

    def __init__(self, centroids: np.ndarray, work: list[tuple[int, int]]) -> None:
        self.centroids, self.work = centroids, work

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
                for c in self.centroids.tolist()]


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS,
            pivots: int = PIVOTS) -> tuple[DataFrame, Clusters]:
    """Vectors with cluster, squared distance and inertias, and the clusters.

    Columns: vec_id, cluster, distance, cluster_inertia (distances of the cluster),
    inertia (of all; both null beyond 64 bits), centroid_sha256. Null vectors, those
    of other lengths and those with a null, NaN or infinite component are left out;
    vectors that repeat each count and get a row. With fewer than k vectors, each is a
    centroid. Without vectors there are no rows. Other columns may have any name.
    """
    whole = written(whole_vectors(embeddings))
    centroids = first_centroids(whole, k)
    fixed = choose_pivots(centroids, pivots)
    vectors = written(with_pivots(whole, fixed))
    work = []
    for _ in range(rounds):
        found = cluster_sums(vectors, centroids, fixed).collect()
        work.append((sum(r.n for r in found), sum(r.measured for r in found)))
        moved = centroids.copy()
        for row in found:
            moved[row.cluster] = [row[s] // row.n for s in _SUMS]
        centroids = moved
    spark = embeddings.sparkSession
    clusters = Clusters(centroids, work)
    rows = written(assigned(vectors, centroids, fixed))
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    per_cluster = {r.cluster: int(r.total) for r in sums.collect()}

    def fitting(total: int) -> int | None:
        return total if total < 2**63 else None

    every = fitting(sum(per_cluster.values()))
    # One row for each centroid.
    digests = clusters.digests()
    names = spark.createDataFrame(
        [(n, fitting(total), every, digests[n]) for n, total in sorted(per_cluster.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return rows.join(F.broadcast(names), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    ), clusters
