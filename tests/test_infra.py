import pytest
from helpers import T0, at, frame, rows, telemetry
from pyspark.sql import functions as F

from tallyforge import functions as fn
from tallyforge import schema
from tallyforge.operators import aggregates as agg
from tallyforge.operators import infra, quality, rollup
from tallyforge.sources import varbinds


def hourly(spark, levels, total=500.0, device="d"):
    data = [(device, at(86400 * i), float(v), total) for i, v in enumerate(levels)]
    return spark.createDataFrame(data, "device_id string, bucket timestamp, avg_disk_used double, avg_disk_total double")


@pytest.mark.parametrize(
    "levels,want", [([1, 2, 3, 4, 5, 6], None), ([9, 8, 7, 6, 5, 4, 3], (None,)), ([480, 485, 490, 495, 500, 505, 510], (0.0,)), ([100, 110, 120, 130, 140, 150, 160], (34.0,)), ([1, 1.001, 1.002, 1.003, 1.004, 1.005, 1.006], (3650.0,))]
)
def test_disk_forecast(spark, levels, want):
    got = rows(infra.disk_forecast(hourly(spark, levels), at(86400 * 7)))
    assert (tuple(r["days_until_full"] for r in got) or None) == want


def counters(spark, a, b, dt=10.0, name="eth0", status=1):
    keys = ["rx64", "tx64", "rx32", "tx32"]
    from decimal import Decimal

    def row(ts, v):
        return {"device_id": "d", "iface": "1", "name": name, "ts": ts, "status": status, **{k: Decimal(v.get(k, 0)) for k in keys}}

    return frame(spark, schema.COUNTERS, [row(T0, a), row(at(dt), b)])


@pytest.mark.parametrize(
    "a,b,kw,want",
    [
        (dict(rx32=100_000_000, tx32=50_000_000), dict(rx32=200_000_000, tx32=100_000_000), {}, (80.0, 40.0)),
        (dict(rx64=10**12, tx64=5 * 10**11, rx32=1000, tx32=500), dict(rx64=2 * 10**12, tx64=10**12, rx32=2000, tx32=1000), {}, (0.0, 0.0)),
        (dict(rx64=10**9, rx32=5), dict(rx64=2 * 10**9, rx32=9), {}, (800.0, 0.0)),
        (dict(rx32=4294967295, tx32=1), dict(rx32=100, tx32=1), {}, (0.0, 0.0)),
        (dict(rx64=2**64 - 1_000_000), dict(rx64=250_000), {}, (1.0, 0.0)),
        (dict(rx32=10**9), dict(rx32=2 * 10**9), {"status": 2}, (0.0, 0.0)),
        (dict(), dict(rx32=10**6), {}, (0.0, 0.0)),
        (dict(rx32=10), dict(rx32=10**6), {"dt": 0.4}, (0.0, 0.0)),
    ],
)
def test_counter_rate(spark, a, b, kw, want):
    got = rows(infra.counter_rate(counters(spark, a, b, **kw)), "ts")
    assert (got[0]["rx_mbps"], got[0]["tx_mbps"]) == (0.0, 0.0)
    assert (got[1]["rx_mbps"], got[1]["tx_mbps"]) == want


def test_unnamed_interface_is_dropped(spark):
    assert rows(infra.counter_rate(counters(spark, {}, {}, name=""))) == []


def vb(spark, walker, items):
    return frame(spark, schema.VARBINDS, [{"device_id": "d", "ts": T0, "walker": walker, "oid": o, "value": str(v)} for o, v in items])


def test_cpu_and_temperature_walks(spark):
    cpu = rows(varbinds.cpu_metrics(vb(spark, "cpu", [(f"1.3.6.1.2.1.25.3.3.1.2.{i}", v) for i, v in enumerate((50, 70, 30, 90), 1)] + [("1.3.9", 5)])))[0]
    assert cpu["cpu_cores"] == 4 and cpu["cpu_load_percent"] == 60.0 and cpu["cpu_metrics"]["core_4"] == 90.0
    assert rows(varbinds.cpu_metrics(vb(spark, "cpu", [("1,3,6,1,4,1,2636,3,1,13,1,8,9,1,0,0", 500)])))[0]["cpu_load_percent"] == 100.0
    hot = rows(varbinds.temp_metrics(vb(spark, "temp", [("1.3.6.1.4.1.2021.13.16.2.1.7.0", 9999), ("1.3.6.1.4.1.2021.13.16.2.1.7.1", -5)])))[0]
    assert hot["temp_c"] == 150.0 and hot["temp_metrics"] == {"sensor_0": 9999.0}


def store(entries):
    return [(f"1.3.6.1.2.1.25.2.3.1.{p}.{i}", v) for i, e in entries.items() for p, v in zip("2456", e)]


def test_storage_walk(spark):
    got = rows(varbinds.storage_metrics(vb(spark, "storage", store({1: ("1.3.6.1.2.1.25.2.1.2", 4096, 8388608, 4194304), 2: ("1.3.6.1.2.1.25.2.1.4", 512, 1048576, 524288)}))))[0]
    assert (got["ram_total_mb"], got["ram_used_mb"], got["ram_free_mb"]) == (32768.0, 16384.0, 16384.0) and got["disk_total_gb"] == 0.5
    over = rows(varbinds.storage_metrics(vb(spark, "storage", store({1: ("1.3.6.1.2.1.25.2.1.2", 4096, 8388608, 9437184)}))))[0]
    assert over["ram_used_mb"] == over["ram_total_mb"] and over["disk_total_gb"] == 1.0
    huge = rows(varbinds.storage_metrics(vb(spark, "storage", store({1: ("ram", 2**30, 2**30, 5)}))))[0]
    assert huge["ram_total_mb"] == 1048576.0


def test_machine_and_interface_walks(spark):
    m = rows(varbinds.machine_metrics(vb(spark, "ldi", [("1.3.6.1.4.1.9999.1.1.0", 150), ("1.3.6.1.4.1.9999.1.2.0", 2250), ("1.3.6.1.4.1.9999.1.4.2", 300), ("1.3.6.1.4.1.9999.1.4.5", 500)])))[0]
    assert (m["throughput"], m["temperature"], m["pe"]) == (150.0, 22.5, 4.0)
    n = rows(varbinds.interface_counters(vb(spark, "net", [("1.3.6.1.2.1.2.2.1.2.3", "ge-0"), ("1.3.6.1.2.1.2.2.1.10.3", 7), ("1.3.6.1.2.1.31.1.1.1.6.3", 99), ("1.3.6.1.2.1.2.2.1.8.3", 2)])))[0]
    assert (n["iface"], n["name"], int(n["rx32"]), int(n["rx64"]), n["status"]) == ("3", "ge-0", 7, 99, 2)


def test_bounds(spark):
    df = spark.createDataFrame([("25.5", "101"), ("-50", "50"), ("9999", "0"), ("abc", None)], "t string, p string")
    assert [(r["t"], r["p"]) for r in rows(fn.validate_bounds(df, {"t": "temperature", "p": "percent"}))] == [(25.5, None), (None, 50.0), (None, 0.0), (None, None)]


def test_percentiles_match_sorting(spark):
    import numpy as np

    xs = [float((i * 7919) % 1000) / 7 - 40 for i in range(999)] + [0.0, 0.0, 1e9, -1e9]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = rows(agg.exact_percentiles(df, [], "v", {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.999, "e": 1.0}))[0]
    for k, p in zip("abcde", (0.0, 0.01, 0.5, 0.999, 1.0)):
        assert got[k] == pytest.approx(float(np.quantile(xs, p)), rel=1e-12)
    assert got["n"] == len(xs)
    assert rows(agg.exact_percentiles(df.where("v is null"), [], "v", {"a": 0.5})) in ([], [{"n": None, "a": None}])


def test_reconcile_and_schema_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "changed"), (4, "new")], "id int, v string")
    assert rows(quality.reconcile(a, b, ["id"]))[0] == {"rows_a": 3, "rows_b": 3, "only_a": 1, "only_b": 1, "changed": 1}
    assert [(r["column_name"], r["side"]) for r in rows(quality.schema_diff(a, b.withColumn("n", F.lit(1))))] == [("n", "b")]


def test_elapsed_and_weeks(spark):
    df = spark.createDataFrame([(59.0,), (3599.0,), (3900.0,), (90000.0,), (-5.0,)], "s double")
    assert [r["e"] for r in rows(df.select(fn.elapsed_text(F.col("s")).alias("e")))] == ["0m", "59m", "1h05m", "1h00m", "0m"]
    monday = spark.createDataFrame([(at(0),)], "t timestamp").select(F.dayofweek(fn.time_bucket("t", "1 week")).alias("d")).first()[0]
    assert monday == 2


def test_distinct_boards_merge_from_minutes(spark):
    rows_ = [{"time": at(60 * m + 7), "board_no": b} for m, b in [(0, 1), (0, 1), (0, 30_000), (1, 1), (5, 2), (61, 1), (62, None)]]
    minutes = rollup.board_bitmaps(telemetry(spark, rows_))
    hours = rollup.distinct_boards(rollup.wider_bitmaps(minutes, "1 hour"))
    assert [(r["bucket"], r["board_count"]) for r in rows(hours, "bucket")] == [(at(0), 3), (at(3600), 1)]
    assert sum(r["board_count"] for r in rows(rollup.distinct_boards(minutes))) == 5
