import random

import numpy as np

from tallyforge.llm import vectors as V
from tallyforge.llm.common import forest

VECS = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, ddl=VECS):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], ddl)


def brute(x, cosine=0.95):
    x = x.astype(np.float32).astype(float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(x @ x.T >= cosine)
    a, b = a[a != b], b[a != b]
    comp = np.arange(len(x))
    u, v = forest(a, b)
    comp[u] = v
    return np.bincount(a, minlength=len(x)), comp


def planted(seed, n, cos):
    """n random vectors and one partner for each at about the given cosine."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    o = rng.normal(size=(n, 64))
    o -= (o * x).sum(axis=1, keepdims=True) * x
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    return np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * o])


def test_recall_just_above_the_bound(spark):
    x = planted(1, 600, 0.952)
    want, _ = brute(x)
    rows = V.near_vectors(frame(spark, enumerate(x.tolist()))).collect()
    got = np.zeros(len(x), int)
    for r in rows:
        got[r.vec_id] = r.n_links
    assert (got <= want).all() and got.sum() >= 0.97 * want.sum()


def clusters(seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, 64))
    x = np.concatenate([c + 0.1 * rng.normal(size=(60, 64)) for c in centre] + [rng.normal(size=(200, 64))])
    return np.concatenate([x, x[:20], 3 * x[20:30]])


def test_clusters_and_copies(spark):
    x = clusters(2)
    want, comp = brute(x)
    for r in V.near_vectors(frame(spark, enumerate(x.tolist()))).collect():
        assert (r.n_links, r.component_id, r.kept) == (want[r.vec_id], comp[r.vec_id], comp[r.vec_id] == r.vec_id)


def test_full_buckets_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(V, "PART", 16)
    x = clusters(3)
    want, comp = brute(x)
    for r in V.near_vectors(frame(spark, enumerate(x.tolist()))).collect():
        assert (r.n_links, r.component_id) == (want[r.vec_id], comp[r.vec_id])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0, 0, 0]), (4, [1, None, 2]), (5, [1, nan, 2]), (6, [inf, 1, 2]), (7, [1, 2, 3]), (8, [2, 4, 6]), (9, [1, 2, 3, 4]), (10, [-1, -2, -3]), (7, [1, 2, 3]), (11, [0.0, 1, 0]), (12, [-0.0, 1, 0])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in V.near_vectors(frame(spark, rows)).collect())
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10)]
    assert got == sorted(alone + [(7, 2, 7, True), (7, 2, 7, True), (8, 2, 7, False), (11, 1, 11, True), (12, 1, 11, False)])
    assert V.near_vectors(frame(spark, [])).count() == 0


def test_hash_buckets_are_different_and_stable():
    x = np.random.default_rng(4).normal(size=(50, 30))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = V.buckets(x)
    assert all(len(set(r)) == V.TABLES * V.PROBES for r in ids.tolist()) and (ids == V.buckets(x)).all()
    assert random.Random(0) is not None
