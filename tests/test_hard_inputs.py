"""Inputs the benchmark tables do not hold: zero runs, resets, gaps, NaN, malformed numbers, very large values."""
import json
import math

import pytest
from helpers import at, frame, rows
from pyspark.sql import functions as F

from tallyforge.functions.numbers import pg_int, rnd
from tallyforge.operators.aggregates import exact_percentiles
from tallyforge.operators.infra import counter_rate, rate_over
from tallyforge.operators.joins import latest_per_key
from tallyforge.sources import ingest
from tallyforge.sources.varbinds import half_average, machine_metrics, position_error
from tallyforge.streaming import jobs


def levels(spark, values):
    df = frame(spark, "k string, ts timestamp, x double", [{"k": "m", "ts": at(i), "x": v} for i, v in enumerate(values)])
    return [r["z"] for r in rows(half_average(df, ["k"], ["ts"], "x", "z"), "ts")]


def test_half_average_has_no_horizon(spark):
    assert levels(spark, [5.0, *[0.0] * 70, 8.0])[-1] == 4.0


def test_half_average_restarts_at_exact_zero(spark):
    assert levels(spark, [0.0, 0.0, 4.0, -4.0, 6.0, None, 2.0]) == [0.0, 0.0, 4.0, 0.0, 6.0, 4.0]


def test_two_sensors_are_halved_one_after_the_other(spark):
    oids = ["1.3.6.1.4.1.9999.1.4.2", "1.3.6.1.4.1.9999.1.4.5"]
    walk = [{"device_id": "m", "ts": at(60 * p), "walker": "ldi", "oid": o, "value": str(100 * v)} for p, pair in enumerate([(10, 2), (4, 8)]) for o, v in zip(oids, pair)]
    df = frame(spark, "device_id string, ts timestamp, walker string, oid string, value string", walk)
    assert [r["pe"] for r in rows(position_error(df), "ts")] == [6.0, 6.5]
    assert machine_metrics(df).count() == 2


def test_a_counter_reset_counts_from_zero(spark):
    df = frame(spark, "k string, ts timestamp, v long", [{"k": "c", "ts": at(60 * i), "v": v} for i, v in enumerate([100, 200, 0, 50])])
    assert rows(rate_over(df, ["k"], "ts", "v", "5 minutes"))[0]["rate"] == 150 / 300


COUNTERS = "device_id string, iface string, name string, ts timestamp, status int, rx32 long, tx32 long, rx64 long, tx64 long, errors long, drops long"


def counter_rows(spark):
    def row(poll, iface, rx, name="eth"):
        return {"device_id": "d", "iface": iface, "name": name, "ts": at(10 * poll), "status": 1, "rx32": 0, "tx32": 0, "rx64": rx, "tx64": rx, "errors": poll, "drops": 7}

    # interface 2 is absent from poll 1, and without a name in poll 3
    polls = [(0, "1", 1000), (0, "2", 1000), (1, "1", 2_001_000), (2, "1", 4_001_000), (2, "2", 9_000_000), (3, "1", 6_001_000), (3, "2", 11_000_000, ""), (4, "2", 13_000_000)]
    return frame(spark, COUNTERS, [row(*p) for p in polls])


def test_rates_compare_with_the_devices_last_poll(spark):
    got = {(r["ts"], r["rx_mbps"], r["errors"]) for r in rows(counter_rate(counter_rows(spark)))}
    assert got == {(at(0), 0.0, 0), (at(10), 1.6, 1), (at(20), 1.6, 2), (at(20), 0.0, 2), (at(30), 1.6, 3), (at(40), 1.6, 4)}


def test_streamed_rates_over_several_batches(spark, tmp_path):
    data = counter_rows(spark)
    for p in range(5):
        data.where(F.col("ts") == F.lit(at(10 * p))).coalesce(1).write.parquet(f"{tmp_path}/in/{p}")
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = jobs.run_available(jobs.counter_rate_stream(stream), "rates")
    key = lambda r: (r["ts"], r["rx_mbps"], r["errors"], r["drops"])
    assert sorted(map(key, rows(out))) == sorted(map(key, rows(counter_rate(data))))


def test_percentiles_put_nan_last(spark):
    df = frame(spark, "k string, x double", [{"k": "a", "x": v} for v in (-1.0, 1.0, 2.0, 3.0, math.nan)] + [{"k": "b", "x": math.inf}, {"k": "b", "x": math.nan}, {"k": "b", "x": -math.inf}])
    got = {r["k"]: r for r in rows(exact_percentiles(df, ["k"], "x", {"p50": 0.5, "top": 1.0}))}
    assert got["a"]["p50"] == 2.0 and math.isnan(got["a"]["top"]) and got["b"]["p50"] == math.inf and math.isnan(got["b"]["top"])


@pytest.mark.parametrize("value, want", [("NaN", None), ("12d", None), (" 12.5 ", 12.5), ("1e3", 1000.0), ("", None), (7, 7.0), ("abc", None), (None, None)])
def test_only_numbers_count_as_numbers(spark, value, want):
    df = spark.createDataFrame([(json.dumps({"eqp_id": "m", "temperature": value}),)], "value string")
    assert ingest.ingest_telemetry(df).first()["temperature"] == want


@pytest.mark.parametrize("state, want", [(False, False), ("false", True), (True, True), (None, True), (0, True), ("x", True)])
def test_only_the_boolean_false_is_off(spark, state, want):
    df = spark.createDataFrame([(json.dumps([{"eqp_id": "m", "state": state}]),)], "value string")
    assert ingest.ingest_telemetry(df).first()["state"] is want


def test_rounding_bears_large_values_and_does_not_round_twice(spark):
    df = spark.createDataFrame([(0.4999996, 1e33, -2.5, math.nan, 2.675)], "a double, b double, c double, d double, e double")
    r = df.select(rnd("a", 0).alias("a"), rnd("b", 2).alias("b"), pg_int("c").alias("c"), rnd("d", 1).alias("d"), rnd("e", 2).alias("e")).first()
    assert (r.a, r.b, r.c, r.e) == (0.0, 1e33, -3, 2.68) and math.isnan(r.d)


def test_latest_row_is_found_by_hash(spark):
    df = frame(spark, "k string, ts timestamp, id string, x double", [{"k": k, "ts": t, "id": i, "x": 1.0} for k, t, i in [("a", at(1), "1"), ("a", at(2), "1"), ("a", at(2), "2"), (None, at(1), "9"), ("b", None, "1"), ("b", None, "3")]])
    got = latest_per_key(df, ["k"], "ts", "id")
    assert {(r["k"], r["ts"], r["id"]) for r in rows(got)} == {("a", at(2), "2"), (None, at(1), "9"), ("b", None, "3")}
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
