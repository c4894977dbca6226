"""Poll cycles at the poll interval, over chunk edges, and as a stream."""
import random

import pytest
from helpers import at, frame, rows

from tallyforge.operators.cycles import poll_cycles
from tallyforge.session import scratch_path
from tallyforge.streaming.jobs import run_available
from tallyforge.streaming.ordered import poll_cycles_stream

PARTS = "device_id string, ts timestamp, walker string, part string, cpu double, temp double"
NEEDED = ("cpu", "storage", "temp")


def parts(spark, items):
    return frame(spark, PARTS, [{"device_id": d, "ts": at(t), "walker": w, "part": f"{i:05d}", "cpu": float(i) if w == "cpu" else None, "temp": float(i) if w == "temp" else None} for i, (d, t, w) in enumerate(items)])


def folded(items):
    """(device, start, close, complete, walkers) by a plain pass over the parts."""
    out = []
    for d in {i[0] for i in items}:
        open_ = None
        for _, t, _, w in sorted((x[0], x[1], i, x[2]) for i, x in enumerate(items) if x[0] == d and x[2] in NEEDED):
            if open_ and t >= open_[0] + 35:
                out.append((d, at(open_[0]), at(open_[0] + 35), False, sorted(open_[1])))
                open_ = None
            open_ = open_ or (t, set())
            open_[1].add(w)
            if len(open_[1]) == 3:
                out.append((d, at(open_[0]), at(t), True, sorted(open_[1])))
                open_ = None
        if open_:
            out.append((d, at(open_[0]), at(open_[0] + 35), False, sorted(open_[1])))
    return sorted(out)


def told(df):
    return sorted((r["device_id"], r["cycle_start"], r["closed_at"], r["complete"], r["walkers"]) for r in rows(df))


def polls(n, missing=()):
    return [("d", 30 * p + k, w) for p in range(n) for k, w in enumerate(("cpu", "storage", "temp", "net")) if (p, w) not in missing]


def test_polls_thirty_seconds_apart_stay_apart(spark):
    got = rows(poll_cycles(parts(spark, polls(4)), tie="part"), "cycle_start")
    assert [(r["cycle_start"], r["closed_at"], r["complete"], r["cpu"]) for r in got] == [(at(30 * p), at(30 * p + 2), True, 4.0 * p) for p in range(4)]


def test_a_missing_walker_gives_a_partial_row_at_the_timeout(spark):
    items = polls(3, {(0, "temp"), (1, "temp")})
    got = told(poll_cycles(parts(spark, items), tie="part"))
    assert got == folded(items)
    assert got[0] == ("d", at(0), at(35), False, ["cpu", "storage"])


def noisy(seed, n=400, device="d"):
    rng, t, out = random.Random(seed), 0, []
    for _ in range(n):
        t += rng.choice([0, 0, 1, 1, 3, 9, 20, 36, 50])
        out.append((device, t, rng.choice(["cpu", "cpu", "storage", "temp", "net"])))
    return out


@pytest.mark.parametrize("max_rows", [2, 5, 7, 50, None])
def test_chunks_give_what_one_pass_gives(spark, max_rows):
    items = noisy(max_rows or 1) + noisy(3, 60, "e") + [("f", 5, "cpu")]
    assert told(poll_cycles(parts(spark, items), tie="part", max_rows=max_rows)) == folded(items)


def test_no_parts(spark):
    assert poll_cycles(parts(spark, [])).count() == 0
    assert poll_cycles(parts(spark, [("d", 1, "net")])).count() == 0


def delivered(spark, items, cuts, lag=0, seed=0):
    """The parts as a stream of micro-batches; `lag` seconds of disorder, and a last part of another device long after."""
    rng = random.Random(seed)
    df = parts(spark, [*items, ("~", 100_000, "cpu")])
    data = sorted(df.collect(), key=lambda r: (r["ts"].timestamp() + rng.uniform(0, lag), r["part"]))
    path = scratch_path(spark, "parts")
    for a, b in zip([0, *cuts], [*cuts, len(data)]):
        if a < b:
            spark.createDataFrame(data[a:b], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("cuts, lag", [([], 0), ([100, 101, 250], 0), ([50, 120, 200, 330], 20)])
def test_a_stream_gives_the_same_cycles_however_it_is_cut(spark, cuts, lag):
    items = noisy(11) + noisy(12, 60, "e")
    got = told(run_available(poll_cycles_stream(delivered(spark, items, cuts, lag), tie="part"), "cycles"))
    assert got == folded(items)


def test_the_newest_reading_of_each_walker_is_told(spark):
    items = [("d", 0, "cpu"), ("d", 3, "cpu"), ("d", 4, "temp"), ("d", 60, "temp")]
    got = rows(run_available(poll_cycles_stream(delivered(spark, items, [2]), tie="part"), "cycles"), "cycle_start")
    assert [(r["cpu"], r["temp"]) for r in got] == [(1.0, 2.0), (None, 3.0)]
    assert [(r["cpu"], r["temp"]) for r in rows(poll_cycles(parts(spark, items), tie="part"), "cycle_start")] == [(1.0, 2.0), (None, 3.0)]
