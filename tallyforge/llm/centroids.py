"""Centroid clustering with Ptolemaic pivots: exact assignments, most distances never computed.

For two pivots p, s and any vector x and centroid c, Ptolemy's inequality of Euclidean space gives
d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s). The distances of a vector to the pivots are computed once and
stored beside it; those of the few centroids are computed in each round. A centroid whose bound lies above the best
distance found so far is passed over, the others are compared exactly in integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

COMPONENTS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
PIVOTS = 6
#: below it the squared distance of 64 components fits a long
LARGEST = 1 << 27
# far above what rounding can take from a bound of doubles: a bound is lowered by this share of its two products
_SLACK = 1e-12
_ROWS = 4096


def _grid(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have exactly `COMPONENTS` finite components, and floor(SCALE * x) of those."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    kept = np.flatnonzero(lengths == COMPONENTS)
    flat = column.take(pa.array(kept)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, COMPONENTS)
    # a null component has become NaN
    whole = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        grid = np.floor(x[whole] * SCALE)
    if len(grid) and np.abs(grid).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST / SCALE:g}: squared distances would not fit a long")
    return kept[whole], grid.astype(np.int64)


def _rows(grid: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(grid.reshape(-1)), grid.shape[1]).cast(pa.list_(pa.from_numpy_dtype(grid.dtype)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _gridded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, grid = _grid(batch.column("embedding"))
        if len(kept):
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(kept)), _rows(grid)], ["vec_id", "x"])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of every row of `a` to every row of `b`, in integers."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def lower_bounds(x: np.ndarray, c: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Bounds below the distances of vectors to centroids, from the distances of either to the pivots.

    x: vectors by pivots, c: centroids by pivots, pivots: pivots by pivots; pivots at distance zero make no pair.
    """
    best = np.zeros((len(x), len(c)))
    for p in range(len(pivots)):
        for s in range(p):
            if pivots[p, s] > 0:
                one, two = x[:, p, None] * c[None, :, s], x[:, s, None] * c[None, :, p]
                np.maximum(best, (np.abs(one - two) - _SLACK * (one + two)) / pivots[p, s], out=best)
    return best


def nearest(x: np.ndarray, at: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row of `x` (the smaller number in ties), its squared distance, and distances computed.

    `at` are the rows' distances to the pivots.
    """
    bounds = lower_bounds(at, np.sqrt(_distances(centroids, pivots)), np.sqrt(_distances(pivots, pivots)))
    first = bounds.argmin(axis=1)
    cluster, distance, computed = first.copy(), ((x - centroids[first]) ** 2).sum(axis=1), len(x)
    for k in range(len(centroids)):
        open_ = np.flatnonzero((bounds[:, k] <= np.sqrt(distance) * (1 + _SLACK)) & (first != k))
        if len(open_):
            d = ((x[open_] - centroids[k]) ** 2).sum(axis=1)
            better = (d < distance[open_]) | (d == distance[open_]) & (k < cluster[open_])
            cluster[open_[better]], distance[open_[better]] = k, d[better]
            computed += len(open_)
    return cluster, distance, computed


def _located(pivots: np.ndarray) -> Callable:
    """Adds the distances to the pivots, `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), COMPONENTS)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), _rows(np.sqrt(_distances(x, pivots)))], ["vec_id", "x", "at"])

    return run


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, at = _matrix(batch.column("x"), COMPONENTS), _matrix(batch.column("at"), len(pivots))
    parts = [nearest(x[i : i + _ROWS], at[i : i + _ROWS], centroids, pivots)[:2] for i in range(0, len(x), _ROWS)]
    return x, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _summed(centroids: np.ndarray, pivots: np.ndarray) -> Callable:
    """The rows of a task by centroid: their number and the sums of their components, at most one row a centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(centroids), COMPONENTS), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if len(batch):
                x, cluster, _ = _assigned(batch, centroids, pivots)
                counts += np.bincount(cluster, minlength=len(centroids))
                for k in np.unique(cluster):
                    sums[k] += x[cluster == k].sum(axis=0)
        k, d = np.divmod(np.arange(sums.size), COMPONENTS)
        held = counts[k] > 0
        yield pa.RecordBatch.from_arrays([pa.array(v[held]) for v in (k, d, sums.reshape(-1), counts[k])], ["k", "d", "s", "n"])

    return run


def _final(centroids: np.ndarray, pivots: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                _, cluster, distance = _assigned(batch, centroids, pivots)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def _chosen(vectors: DataFrame, salt: str, n: int) -> np.ndarray:
    """The n vectors whose salted id has the smallest sha256; of one id the smaller vector comes first."""
    rows = vectors.select("x", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"))
    rows = rows.orderBy(F.col("h").asc_nulls_last(), "x").limit(n).collect()
    return np.array([r.x for r in rows], np.int64).reshape(-1, COMPONENTS)


def cluster(vectors: DataFrame, n: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) for every usable row of `vectors`.

    A row is usable if `embedding` has exactly 64 components, none null, NaN or infinite; others have no row in the
    result. Rows that repeat an id are rows of their own; a null id comes last in the choice of the first centroids. With
    fewer rows than centroids every row begins as one. An empty table gives none. Components of 2^21 or more raise an
    error, since their squared distances need not fit a long. `centroid` is the final one, distances are squared.
    """
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = written(usable.mapInArrow(_gridded, "vec_id long, x array<long>"), "vectors")
    centroids, pivots = _chosen(usable, "1", n), _chosen(usable, "2", PIVOTS)
    if not len(centroids):
        return usable.select("vec_id", *[F.lit(0).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"))], F.col("x").alias("centroid"))
    located = written(usable.mapInArrow(_located(pivots), "vec_id long, x array<long>, at array<double>"), "located")
    for _ in range(rounds):
        sums = located.mapInArrow(_summed(centroids, pivots), "k long, d long, s long, n long").groupBy("k", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
        centroids = centroids.copy()
        for r in sums.collect():  # one row a centroid and component
            centroids[r.k, r.d] = int(r.s) // r.n
    found = written(located.mapInArrow(_final(centroids, pivots), "vec_id long, cluster int, distance long"), "clusters")
    each = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    spark = vectors.sparkSession
    told = spark.createDataFrame([(k, s, sum(each.values()), centroids[k].tolist()) for k, s in each.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
