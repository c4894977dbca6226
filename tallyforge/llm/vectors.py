"""Near-duplicates of embeddings: cross-polytope hashing, multiprobe buckets, verified pairs.

A vector is turned by fast Hadamard rotations; the axis it lies nearest to, with its sign, is one hash, two of them are
a bucket of one table. A vector enters the PROBES buckets nearest to it in each table, so that two close vectors that
fall to different axes still meet. Pairs that meet are verified by their cosine in double precision, so no pair below
the bound is linked; recall on the tables here is measured in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forest, written
from .components import connected_components

COSINE = 0.95
TABLES = 4
PROBES = 4
_AXES = 4
#: rows of a bucket compared in one task; a fuller bucket is dealt into parts, and each pair of parts is a group
PART = 2048
_PAIRS = 1 << 15


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def _rotated(x: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(3):
        x = _hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def buckets(x: np.ndarray) -> np.ndarray:
    """Ids of the TABLES x PROBES buckets of each row of unit vectors (rows x dimensions), different within a row."""
    n, d = x.shape
    wide = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, wide - d)))
    out = np.empty((n, TABLES, PROBES), np.int64)
    k = min(_AXES, wide)
    for t in range(TABLES):
        codes, losses = [], []
        for f in range(2):
            y = _rotated(x, 1000 * d + 2 * t + f)
            size = np.abs(y)
            near = np.argsort(-size, axis=1, kind="stable")[:, :k]
            top = np.take_along_axis(size, near, axis=1)
            codes.append(near * 2 + (np.take_along_axis(y, near, axis=1) < 0))
            losses.append((top[:, :1] - top) ** 2)
        loss = (losses[0][:, :, None] + losses[1][:, None, :]).reshape(n, k * k)
        both = (codes[0][:, :, None] * (2 * wide) + codes[1][:, None, :]).reshape(n, k * k)
        best = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
        out[:, t] = (d * TABLES + t) * (4 * wide * wide) + np.take_along_axis(both, np.resize(best, (n, PROBES)) if best.shape[1] < PROBES else best, axis=1)
    return out.reshape(n, -1)


def _rows(column: pa.Array, dtype: type) -> list[np.ndarray | None]:
    """Each row as an array, or None where it is null, empty, or holds a null."""
    values, offsets, out = column.values, column.offsets.to_numpy(), []
    bad = np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False)) if values.null_count else np.zeros(0, np.int64)
    flat = values.fill_null(0).to_numpy(zero_copy_only=False).astype(dtype)
    for i, known in enumerate(column.is_valid().to_numpy(zero_copy_only=False)):
        a, b = offsets[i], offsets[i + 1]
        out.append(flat[a:b] if known and b > a and np.searchsorted(bad, a) == np.searchsorted(bad, b) else None)
    return out


def _keys(dtype: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r if r is not None and np.isfinite(r).all() and r.any() else None for r in _rows(batch.column("embedding"), dtype)]
            # adding zero makes minus zero plain zero
            keys = pa.array([None if r is None else (r + dtype(0)).tobytes() for r in out], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), keys], ["vec_id", "key"])

    return run


def _unit(keys: list[bytes], dtype: type) -> np.ndarray:
    x = np.frombuffer(b"".join(keys), dtype).reshape(len(keys), -1).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _placed(dtype: type):
    """A row for each bucket of each vector, which carries the ids of all buckets of that vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, copies, keys = (batch.column(c).to_pylist() for c in ("rep", "copies", "key"))
            for size in sorted({len(k) for k in keys}):
                at = [i for i, k in enumerate(keys) if len(k) == size]
                for j in range(0, len(at), 1024):
                    part = at[j : j + 1024]
                    ids = buckets(_unit([keys[i] for i in part], dtype))
                    width = ids.shape[1]
                    several = lambda values: [v for v in values for _ in range(width)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids.ravel()), pa.array(several([reps[i] for i in part]), pa.int64()), pa.array(several([copies[i] for i in part]), pa.int64()), pa.array(several([keys[i] for i in part]), pa.binary()), pa.array(several([r.tobytes() for r in ids]), pa.binary())],
                        ["bucket", "rep", "copies", "key", "ids"],
                    )

    return run


def _first_meeting(ids_a: np.ndarray, ids_b: np.ndarray, here: int) -> np.ndarray:
    """Whether `here` is the smallest bucket that two rows share: there, and only there, their link counts."""
    common = (ids_a[:, :, None] == ids_b[:, None, :]).any(axis=2)
    return np.where(common, ids_a, np.iinfo(np.int64).max).min(axis=1) == here


def _verify(bucket: int, rows: list[tuple], dtype: type, cosine: float) -> tuple[dict[int, int], list[tuple[np.ndarray, np.ndarray]]]:
    """Links of one group: how many vectors each representative is linked to, and edges that tie them together."""
    rep, copies = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x, ids = _unit([r[2] for r in rows], dtype), np.frombuffer(b"".join(r[3] for r in rows), np.int64).reshape(len(rows), -1)
    side = np.array([r[4] for r in rows])
    # a group is one part with itself, or two parts with each other
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side == side.max())
    linked, edges = np.zeros(len(rows), np.int64), []
    step = max(1, (1 << 20) // max(1, len(right)))
    for i in range(0, len(left), step):
        a, b = np.nonzero(x[left[i : i + step]] @ x[right].T >= cosine)
        a, b = left[a + i], right[b]
        keep = rep[a] < rep[b] if side.min() == side.max() else rep[a] != rep[b]
        a, b = a[keep], b[keep]
        for j in range(0, len(a), _PAIRS):
            p, q = a[j : j + _PAIRS], b[j : j + _PAIRS]
            first = _first_meeting(ids[p], ids[q], bucket)
            np.add.at(linked, p[first], copies[q[first]])
            np.add.at(linked, q[first], copies[p[first]])
        if len(a):
            edges.append(forest(rep[a], rep[b]))
    return {int(rep[i]): int(linked[i]) for i in np.flatnonzero(linked)}, edges


def _verified(dtype: type, cosine: float):
    """Groups arrive together, sorted; one group at a time is held, of two parts at most."""

    def flush(key: tuple, rows: list[tuple]) -> Iterator[tuple[list, list, list]]:
        if len(rows) > 1 and len({len(r[2]) for r in rows}) == 1:
            linked, edges = _verify(key[0], rows, dtype, cosine)
            a, b = [*linked], [None] * len(linked)
            n = [*linked.values()]
            for u, v in edges:
                a, b, n = a + u.tolist(), b + v.tolist(), n + [0] * len(u)
            if a:
                yield a, b, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def out(found) -> Iterator[pa.RecordBatch]:
            for a, b, n in found:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("bucket", "i", "j", "rep", "copies", "key", "ids", "part"))
            for bucket, i, j, *row in zip(*columns):
                if (bucket, i, j) != key:
                    if key:
                        yield from out(flush(key, rows))
                    key, rows = (bucket, i, j), []
                rows.append(tuple(row))
        if key:
            yield from out(flush(key, rows))

    return run


def _groups(placed: DataFrame) -> DataFrame:
    """Rows by (bucket, i, j): buckets over PART rows are dealt into parts by hash, each two of which meet once."""
    full = placed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("bucket", F.ceil(F.col("n") / PART).alias("parts"))
    # written, so that its true size is known when the join is planned: mostly there are few full buckets or none
    full = written(full, "full")
    rows = placed.join(full, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), "parts"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return rows.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "rep", "copies", "key", "ids", "part")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding).

    n_links counts the other vectors at or above the cosine, copies among them; component_id is the smallest vec_id
    reachable, itself included; kept says that the two are equal. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, and vectors of different lengths do not link. Equal vectors are compared
    once. Rows without an id have no links and no component; different vectors of one id are vectors of their own. An
    empty table gives no row.
    """
    element = vectors.schema["embedding"].dataType.elementType
    dtype = np.float32 if isinstance(element, T.FloatType) else np.float64
    wanted = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(T.ArrayType(T.FloatType() if dtype is np.float32 else T.DoubleType())).alias("embedding"))
    keyed = written(wanted.mapInArrow(_keys(dtype), "vec_id long, key binary"), "vectors")
    # every different vector has a number of its own, since an id may stand beside several
    distinct = keyed.where("key IS NOT NULL AND vec_id IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    distinct = written(distinct.withColumn("rep", F.monotonically_increasing_id()), "distinct")
    placed = written(distinct.mapInArrow(_placed(dtype), "bucket long, rep long, copies long, key binary, ids binary"), "buckets")
    groups = _groups(placed).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = written(groups.mapInArrow(_verified(dtype, cosine), "a long, b long, n long"), "links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep")
    told = distinct.join(counts, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    told = written(told.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "root", "least"), "told")
    told = told.join(told.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "n_links", "component_id")
    rows = keyed.join(told.withColumnRenamed("key", "__key"), F.col("vec_id").isNotNull() & (F.col("key") == F.col("__key")), "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
