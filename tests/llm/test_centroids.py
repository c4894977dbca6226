"""Clusters against a plain computation, and the bounds against the distances they stand below."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm.centroids import _distances, cluster, lower_bounds, nearest

VECS = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, ddl=VECS):
    return spark.createDataFrame([(i, e, 0) for i, e in rows], ddl)


def blobs(n, seed=1, spread=0.2):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(9, 64))
    return [(i, (middles[i % 9] + spread * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]


def brute(rows):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))[:16]
    centroids = [r[1] for r in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids)) for _, x in kept]

    for _ in range(3):
        at = assign()
        for k in range(len(centroids)):
            own = [x for (_, x), (_, j) in zip(kept, at) if j == k]
            if own:
                centroids[k] = [sum(column) // len(own) for column in zip(*own)]
    at = assign()
    each = {k: sum(d for d, j in at if j == k) for _, k in at}
    return sorted(((i, k, d, each[k], sum(each.values()), tuple(centroids[k])) for (i, _), (d, k) in zip(kept, at)), key=str)


def result(df):
    return sorted(((*r[:5], tuple(r[5])) for r in cluster(df).collect()), key=str)


def test_equals_plain_rounds(spark):
    rows = blobs(400)
    assert result(frame(spark, rows).repartition(5)) == brute(rows)


def test_ties_repeats_and_few_rows(spark):
    rows = blobs(20)
    rows = rows + rows[:5] + [(1, rows[2][1]), (None, rows[3][1]), (90, [0.0] * 64), (91, [-0.001] * 64), (92, [0.0] * 64)]
    assert result(frame(spark, rows)) == brute(rows)
    few = rows[:3]
    assert result(frame(spark, few)) == brute(few)
    same = [(i, [0.25] * 64) for i in range(40)]
    assert result(frame(spark, same)) == brute(same)


def test_unusable_rows_are_left_out(spark):
    rows = blobs(30)
    odd = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [1.0] * 63 + [None]), (105, [float("nan")] + [1.0] * 63), (106, [float("inf")] * 64)]
    assert result(frame(spark, rows + odd)) == brute(rows)
    assert result(frame(spark, odd)) == []


def test_empty_table_doubles_and_extra_columns(spark):
    assert cluster(frame(spark, [])).collect() == []
    rows = blobs(40)
    df = frame(spark, rows)
    for c in ("x", "at", "cluster", "distance", "k", "d", "s", "n"):
        df = df.withColumn(c, F.lit("x"))
    assert result(df) == brute(rows)
    assert result(frame(spark, rows, "vec_id long, embedding array<double>, label int")) == brute(rows)


def test_too_large_components_are_told(spark):
    with pytest.raises(Exception, match="would not fit a long"):
        cluster(frame(spark, [(1, [1e30] * 64)])).collect()


@pytest.mark.parametrize("scale", [1, 1000, 1 << 20])
def test_bounds_lie_below_and_save_work(scale):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(16, 64)) * 40 * scale
    x = np.floor(middles[rng.integers(0, 16, 5000)] + rng.normal(size=(5000, 64)) * 4 * scale).astype(np.int64)
    c, p = np.floor(middles).astype(np.int64), x[:6]
    at = np.sqrt(_distances(x, p))
    exact = _distances(x, c)
    assert (lower_bounds(at, np.sqrt(_distances(c, p)), np.sqrt(_distances(p, p))) <= np.sqrt(exact)).all()
    k, d, computed = nearest(x, at, c, p)
    assert (k == exact.argmin(axis=1)).all() and (d == exact.min(axis=1)).all()
    assert computed < 0.5 * exact.size
