import pytest
from helpers import at, frame, rows

from tallyforge.operators.infra import rate_degraded, rate_over

#: (seconds, reading): resets, readings at one time, a bucket without a known reading, buckets of one reading
READINGS = [(0, 10), (60, 40), (290, 50), (310, 5), (310, 7), (400, None), (610, None), (910, 107), (1210, 207), (1500, 307), (1790, 7)]


def counter(spark):
    return frame(spark, "k string, ts timestamp, v long", [{"k": k, "ts": at(s), "v": v} for k in ("c", None) for s, v in READINGS])


@pytest.mark.parametrize("max_rows", [None, 2])
@pytest.mark.parametrize("across,want", [(False, [40, 2, 0, 0, 0, 7]), (True, [40, 7, 0, 100, 100, 107])])
def test_increase_per_bucket(spark, across, want, max_rows):
    got = rows(rate_over(counter(spark), ["k"], "ts", "v", "5 minutes", across, max_rows), "k", "bucket")
    assert [r["bucket"] for r in got] == [at(s) for s in (0, 300, 600, 900, 1200, 1500)] * 2
    assert [round(r["rate"] * 300, 9) for r in got] == want * 2


def test_a_counter_read_once_a_bucket_is_not_stalled(spark):
    df = frame(spark, "k string, ts timestamp, v long", [{"k": "c", "ts": at(300 * i), "v": 30 * i} for i in range(5)])
    got = rows(rate_degraded(rate_over(df, ["k"], "ts", "v", "5 minutes", across=True), ["k"]), "bucket")
    assert [r["rate"] for r in got] == [0, 0.1, 0.1, 0.1, 0.1] and [r["status"] for r in got[1:]] == ["OK"] * 4


def test_readings_of_a_bucket_are_not_collected(spark):
    plan = rate_over(counter(spark), ["k"], "ts", "v", "5 minutes")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
