"""Centroid clustering with Ptolemaic pivots.

Lloyd's rounds over vectors of whole numbers. For any four points Ptolemy's inequality gives
    d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q),
so a pair of pivots (p, q) bounds the distance of a vector x from a centroid c by distances from
the pivots alone. Pivots and their pairs are fixed before the first round, by clustering a bounded
sample; the distances of the vectors from the pivots are computed once and stored beside the
vectors, those of the few centroids once a round. A vector meets the centroids in the order of their bounds; a centroid
whose bound, rounded down, exceeds the best distance so far is passed over, and the others are
measured exactly in whole numbers. So the assignment is that of a full search, ties included.

What leaves a task is a row per cluster: sums and counts. The driver holds the centroids and the
pivots, whose number is a setting.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.session import stage

# Squares of whole numbers up to here, summed over 64 components, fit 64 bits; greater ones are Python integers.
PLAIN = 1 << 27
LONGEST = (1 << 63) - 1
# What doubles lose in a bound: a few roundings of 2^-53 each, taken generously.
ROUNDING = 2.0**-44


@dataclass(frozen=True)
class Settings:
    dims: int = 64
    scale: int = 64
    clusters: int = 16
    rounds: int = 3
    seed: str = "1"  # first part of the text whose hash chooses the first centroids
    sample: int = 2048  # vectors, first in the same order, that pivots are made from
    batch: int = 4096  # vectors that are compared at once


def quantized(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id and the components as floor(scale * x), of vectors of the right length without null or non-finite ones."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.select("vec_id", "embedding").where(F.size("embedding") == settings.dims).where(finite)
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * settings.scale)).alias("parts"))


def first_vectors(vectors: DataFrame, settings: Settings, n: int) -> list[list[int]]:
    """The ``n`` vectors that come first by the hash of seed and id; vectors without id come last."""
    order = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("vec_id").cast("string")), 256)
    return [row["parts"] for row in vectors.orderBy(order.asc_nulls_last(), "parts").limit(n).collect()]


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of equal rows."""
    gap = a - b
    return (gap * gap).sum(axis=-1)


def matrix(rows: Sequence[Sequence[int]] | np.ndarray) -> np.ndarray:
    """Whole numbers for exact squares: of 64 bits, or of any size where those would not do."""
    found = np.array(rows, dtype=np.int64)
    plain = not found.size or (found.min() >= -PLAIN and found.max() < PLAIN)
    return found if plain else found.astype(object)


class Pivots:
    """Fixed points near which the centroids are expected, and a pair of pivots for each of them.

    The points are the first centroids and where those of a bounded sample end; a bound is tightest
    for a centroid that lies near one pivot of its pair, and for pairs that lie far apart.
    """

    def __init__(self, sample: np.ndarray, settings: Settings) -> None:
        points = sample.astype(np.float64)
        centres = points[: settings.clusters]
        for _ in range(settings.rounds):
            squares = (points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)[None]
            place = squares.argmin(axis=1)
            centres = np.array([points[place == k].mean(axis=0) if (place == k).any() else centres[k] for k in range(len(centres))])
        self.points = np.unique(np.concatenate([points[: settings.clusters], np.floor(centres)]), axis=0)
        apart = np.linalg.norm(self.points[:, None] - self.points[None], axis=2)
        pairs = sorted({(min(k, far), max(k, far)) for k, far in enumerate(apart.argmax(axis=1)) if apart[k, far] > 0})
        self.low, self.high = (np.array([pair[side] for pair in pairs], dtype=np.int64) for side in (0, 1))
        self.apart = apart[self.low, self.high]

    def distances(self, rows: np.ndarray) -> np.ndarray:
        """Distances of the rows from all pivots."""
        out = np.empty((len(rows), len(self.points)))
        plain = rows.astype(np.float64)
        for k, point in enumerate(self.points):
            out[:, k] = np.linalg.norm(plain - point, axis=1)
        return out

    def bounds(self, rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """A lower bound of the squared distance of every row from every centroid, from their pivot distances."""
        best = np.zeros((len(rows), len(centroids)))
        for p, q, apart in zip(self.low, self.high, self.apart, strict=True):
            one = rows[:, p, None] * centroids[None, :, q]
            other = rows[:, q, None] * centroids[None, :, p]
            np.maximum(best, (np.abs(one - other) - (one + other) * ROUNDING) / apart, out=best)
        return best * best * (1 - ROUNDING)


def nearest(
    rows: np.ndarray, near: np.ndarray, centroids: np.ndarray, centroid_near: np.ndarray, pivots: Pivots
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, the smaller number on ties, and how many were measured."""
    count = len(rows)
    # Whole numbers beyond doubles have no safe bound: all their distances are computed.
    safe = rows.dtype != object
    bounds = pivots.bounds(near, centroid_near) if safe else np.zeros((count, len(centroids)))
    order = np.argsort(bounds, axis=1, kind="stable")
    place = order[:, 0].copy()
    best = square_distances(rows, centroids[place])
    measured = np.ones(count, dtype=np.int32)
    alive = np.arange(count)
    for k in range(1, len(centroids)):
        other = order[alive, k]
        alive = alive[bounds[alive, other] <= best[alive].astype(np.float64)]  # bounds rise, so what stops has stopped
        if not len(alive):
            break
        other = order[alive, k]
        found = square_distances(rows[alive], centroids[other])
        measured[alive] += 1
        better = (found < best[alive]) | ((found == best[alive]) & (other < place[alive]))
        best[alive[better]], place[alive[better]] = found[better], other[better]
    return place, best, measured


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dims)


def _with_pivots(vectors: DataFrame, pivots: Pivots, settings: Settings) -> DataFrame:
    """The vectors with their distances from the pivots."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # two vectors per cluster at most
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            near = shared.value.distances(_rows(batch.column("parts"), settings.dims))
            border = pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1])
            lists = pa.ListArray.from_arrays(border, pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["vec_id", "parts", "near"])

    return vectors.mapInArrow(run, f"vec_id {kind}, parts array<long>, near array<double>")


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, pivots: Pivots, settings: Settings):
    """Slices of a batch with place, squared distance and measured of their rows."""
    for low in range(0, batch.num_rows, settings.batch):
        part = batch.slice(low, settings.batch)
        raw = _rows(part.column("parts"), settings.dims)
        rows = matrix(raw)
        kind = object if object in (rows.dtype, centroids.dtype) else np.int64
        near = _rows(part.column("near"), len(pivots.points))
        yield part, raw, nearest(rows.astype(kind), near, centroids.astype(kind), pivots.distances(centroids), pivots)


def _sums(vectors: DataFrame, centroids: np.ndarray, pivots: Pivots, settings: Settings) -> dict[int, tuple[list[int], int]]:
    """Component sums and number of the vectors of every centroid that has any."""
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, pivots))

    def run(batches):
        centroids, pivots = shared.value
        sums = np.zeros((len(centroids), settings.dims), dtype=object)
        counts = np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            for _, raw, (place, _, _) in _assigned(batch, centroids, pivots, settings):
                for cluster in np.unique(place):
                    chosen = raw[place == cluster]
                    small = not len(chosen) or np.abs(chosen.astype(np.float64)).max() < 2.0**50 / settings.batch
                    sums[cluster] += chosen.sum(axis=0, dtype=np.int64 if small else object)
                    counts[cluster] += len(chosen)
        filled = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(filled.astype(np.int32)),
                pa.array(counts[filled]),
                pa.array([[str(v) for v in sums[k]] for k in filled], pa.list_(pa.string())),
            ],
            ["cluster", "n", "sums"],
        )

    partial = vectors.mapInArrow(run, "cluster int, n long, sums array<string>")
    # Tasks are many, clusters few: rows are added up in two steps, so that no task gets all of a cluster's.
    exact = [F.col("sums")[k].cast("decimal(38,0)").alias(f"s{k}") for k in range(settings.dims)]
    dealt = partial.select("cluster", F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt"), "n", *exact)
    totals = [F.sum("n").alias("n"), *(F.sum(f"s{k}").cast("decimal(38,0)").alias(f"s{k}") for k in range(settings.dims))]
    rows = dealt.groupBy("cluster", "salt").agg(*totals).groupBy("cluster").agg(*totals).collect()
    return {row["cluster"]: ([int(row[f"s{k}"]) for k in range(settings.dims)], row["n"]) for row in rows}


def cluster(vectors: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """The assignment (vec_id, cluster, distance, measured) and the clusters (cluster, n, cluster_inertia, inertia, centroid).

    ``vectors`` has vec_id and embedding; other columns are ignored. Vectors that are null, of
    another length, or hold a null, NaN or infinite component take no part. Vectors without id do,
    but become first centroids only if there are too few others. Rows that repeat an id are
    vectors of their own; of first centroids with one id the lesser vector comes first. With fewer
    vectors than clusters every vector is a first centroid; empty input gives no rows. Equal
    centroids are told apart by number: the smaller one gets the vectors. Distances and sums are
    exact; a squared distance that does not fit 64 bits is null, as is an inertia.

    ``measured`` counts the centroids whose distance was computed; the others were passed over
    because of their bound.
    """
    spark = vectors.sparkSession
    rows = stage(quantized(vectors, settings), "vectors")
    first = first_vectors(rows, settings, max(settings.sample, settings.clusters))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long, measured int"
    of_clusters = "cluster int, n long, cluster_inertia long, inertia long, centroid array<long>"
    if not first:
        return spark.createDataFrame([], schema), spark.createDataFrame([], of_clusters)
    pivots = Pivots(np.array(first, dtype=np.int64), settings)
    rows = stage(_with_pivots(rows, pivots, settings), "pivot-distances")
    centroids = matrix(first[: settings.clusters])
    for _ in range(settings.rounds):
        sums = _sums(rows, centroids, pivots, settings)
        centroids = matrix([
            [total // sums[k][1] for total in sums[k][0]] if k in sums else old.tolist() for k, old in enumerate(centroids)
        ])
    shared = spark.sparkContext.broadcast((centroids, pivots))

    def run(batches):
        centroids, pivots = shared.value
        for batch in batches:
            for part, _, (place, best, measured) in _assigned(batch, centroids, pivots, settings):
                fits = best <= LONGEST
                distance = pa.array([int(d) if ok else None for d, ok in zip(best, fits, strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(place.astype(np.int32)), distance, pa.array(measured)],
                    ["vec_id", "cluster", "distance", "measured"],
                )

    assigned = stage(rows.mapInArrow(run, schema), "assigned")
    return assigned, _inertia(spark, assigned, centroids, of_clusters)


def _inertia(spark: SparkSession, assigned: DataFrame, centroids: np.ndarray, schema: str) -> DataFrame:
    """A row per centroid, with what its vectors' distances add up to."""
    whole = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("total")
    totals = {row["cluster"]: row for row in assigned.groupBy("cluster").agg(F.count("*").alias("n"), whole).collect()}
    sums = [totals[k]["total"] if k in totals else 0 for k in range(len(centroids))]
    everything = None if None in sums else sum(int(s) for s in sums)
    rows = []
    for k, centroid in enumerate(centroids.tolist()):
        own = None if sums[k] is None or sums[k] > LONGEST else int(sums[k])
        of_all = None if everything is None or everything > LONGEST else everything
        rows.append((k, totals[k]["n"] if k in totals else 0, own, of_all, [int(x) for x in centroid]))
    return spark.createDataFrame(rows, schema)
