"""Recurrences over chunks must give what one pass over the history gives."""
import math
import random

import pytest
from helpers import at, frame, rows
from pyspark.sql import functions as F

from tallyforge.operators import alarms as al
from tallyforge.operators.machines import in_chunks
from tallyforge.operators.recurrences import HalfAverage, LastKnown, Smoothing, Together, half_average, one_sided_sums, smoothed
from tallyforge.operators.series import expanding_stats

SIZES = [1, 3, 16, 10_000]
DDL = "k string, ts timestamp, id long, x double, c boolean"


def history(spark, n=300, seed=4):
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 1, 1, 2, 5, 40])
        out.append({"k": rng.choice(["a", "a", "a", None, "b"]), "ts": at(t), "id": 2**60 + i, "x": rng.choice([None, 0.0, rng.uniform(-5, 5), 7.0]), "c": rng.choice([True, True, True, False, None])})
    return frame(spark, DDL, out).repartition(4), out


def by_key(items):
    for k in ("a", "b", None):
        yield k, [r for r in items if r["k"] == k]


def got(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in rows(df)}


@pytest.mark.parametrize("size", SIZES)
def test_smoothing_passes_over_missing_readings(spark, size):
    df, items = history(spark)
    want = {}
    for _, own in by_key(items):
        z = None
        for r in own:
            if r["x"] is not None:
                z = r["x"] if z is None else 0.3 * r["x"] + 0.7 * z
            want[r["id"]] = z
    have = got(smoothed(df, ["k"], ["ts", "id"], "x", 0.3, "z", size), "z")
    assert have.keys() == want.keys()
    for i, z in want.items():
        assert (have[i][0] is None) == (z is None) and (z is None or have[i][0] == pytest.approx(z, abs=1e-9))


@pytest.mark.parametrize("size", SIZES)
def test_one_sided_sums(spark, size):
    df, items = history(spark)
    want = {}
    for _, own in by_key(items):
        up = down = 0.0
        for r in own:
            x = r["x"]
            up, down = (up, down) if x is None else (max(0.0, up + x - 1), max(0.0, down - x - 1))
            want[r["id"]] = (up, down)
    have = got(one_sided_sums(df, ["k"], ["ts", "id"], F.col("x") - 1, -F.col("x") - 1, size), "cusum_pos", "cusum_neg")
    for i, w in want.items():
        assert have[i] == pytest.approx(w, abs=1e-9)


@pytest.mark.parametrize("size", SIZES)
def test_a_flood_of_one_key_fires_like_a_plain_pass(spark, size):
    flood = [{"logdate": at(7 * i % 90 + 60 * (i // 9)), "errorcode": "c"} for i in range(400)]
    df = frame(spark, "equipmentid string, errorcode string, logdate timestamp, logid string", [{"equipmentid": "m", "logid": f"{i:04d}", **r} for i, r in enumerate(flood)])
    last, want = None, []
    for r in sorted(rows(df), key=lambda r: (r["logdate"], r["logid"])):
        if last is None or (r["logdate"] - last).total_seconds() >= 720:
            last = r["logdate"]
            want.append(r["logid"])
    assert sorted(r["logid"] for r in rows(al.debounce(df, max_rows=size).where("fired"))) == sorted(want)


@pytest.mark.parametrize("size", SIZES)
def test_held_conditions(spark, size):
    rng = random.Random(8)
    items = [{"k": k, "ts": at(60 * i), "id": i, "c": rng.choice([True] * 6 + [False, None])} for k in ("a", "b") for i in range(120) if rng.random() > 0.05]
    want = {}
    for k in ("a", "b"):
        since = before = None
        for r in [r for r in items if r["k"] == k]:
            if not r["c"]:
                since = None
            elif since is None or (r["ts"] - before).total_seconds() > 60:
                since = r["ts"]
            before = r["ts"]
            want[k, r["ts"]] = "ok" if since is None else "firing" if (r["ts"] - since).total_seconds() >= 300 else "pending"
    have = rows(al.sustained(frame(spark, DDL, items), ["k"], "5 minutes", "1 minute", cond="c", max_rows=size))
    assert {(r["k"], r["ts"]): r["state"] for r in have} == want


@pytest.mark.parametrize("size", SIZES)
def test_half_averages_and_last_known_values_in_one_pass(spark, size):
    df, items = history(spark)
    want = {}
    for _, own in by_key(items):
        level, last, top = 0.0, None, None
        for r in own:
            x = r["x"]
            if x is not None:
                level, last, top = (x if level == 0 else (x + level) / 2), x, x if top is None else max(top, x)
            want[r["id"]] = (None if last is None else level, last, top)
    both = Together(HalfAverage("x", "z"), LastKnown(("x",), ("y",)))
    out = in_chunks(df.withColumn("y", F.col("x")), ["k"], ["ts", "id"], both, {"z": "double", "x_now": "double", "y_now": "double"}, size)
    for i, row in got(out, "z", "x_now", "y_now").items():
        for have, w in zip(row, want[i]):
            assert math.isnan(have) if w is None else have == pytest.approx(w, abs=1e-12)


def test_a_long_chunk_ends_on_its_level_whatever_it_began_with():
    import numpy as np

    rng = np.random.default_rng(2)
    m, v = HalfAverage("x", "z"), rng.choice([0.0, 1.5, -3.0, 4.0], 5000)
    for z in (None, 0.0, 1e300, -2.5):
        assert m.run(z, {"x": v})[1] == pytest.approx(m.advance(z, m.summary({"x": v})), rel=1e-12)
    e = Smoothing("x", 0.2, "z")
    for z in (None, 3.0):
        assert e.run(z, {"x": v[:50]})[1] == pytest.approx(e.advance(z, e.summary({"x": v[:50]})))


def test_half_average_in_small_chunks(spark):
    items = [{"k": "m", "ts": at(i), "id": i, "x": v} for i, v in enumerate([0.0, 0.0, 4.0, -4.0, 6.0, None, 2.0, -4.0, 5.0])]
    for size in (2, 3, 100):
        assert [r["z"] for r in rows(half_average(frame(spark, DDL, items), ["k"], ["ts"], "x", "z", size), "ts")] == [0.0, 0.0, 4.0, 0.0, 6.0, 4.0, 0.0, 5.0]


def test_sigma_does_not_cancel_over_chunk_edges(spark):
    items = [{"k": "a", "ts": at(i), "id": i, "x": 1e9 + (i % 3) * 0.001} for i in range(40)]
    have = got(expanding_stats(frame(spark, DDL, items), ["k"], ["ts"], "x", 4), "mu", "sigma")
    import statistics

    for i in range(2, 40):
        assert have[i][1] == pytest.approx(statistics.stdev(r["x"] for r in items[:i]), rel=1e-3)


def test_no_rows(spark):
    assert smoothed(frame(spark, DDL, []), ["k"], ["ts"], "x", 0.2).count() == 0
    assert half_average(frame(spark, DDL, []), ["k"], ["ts"], "x", "z").count() == 0
