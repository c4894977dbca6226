"""The table of newest rows, snapshots that expire, upserts of repeated keys, and bounds that reach the scan."""
from datetime import datetime, timedelta

from helpers import at, frame, rows
from pyspark.sql import functions as F

from tallyforge.operators.joins import latest_per_key
from tallyforge.plans import QUERIES
from tallyforge.session import scratch_path
from tallyforge.sources import ingest, maintenance
from tallyforge.sources.latest import latest_writer, merge_latest, read_latest

DDL = "k string, ts timestamp, id long, x double"


def batch(spark, items):
    return frame(spark, DDL, [{"k": k, "ts": at(t), "id": i, "x": float(i)} for k, t, i in items])


def test_late_rows_lose_and_retries_change_nothing(spark):
    path = scratch_path(spark, "latest")
    batches = [[("a", 10, 1), ("b", 10, 2), (None, 5, 3)], [("a", 5, 4), ("c", 1, 5), (None, 6, 6)], [("b", 10, 7), ("b", 10, 1), ("a", 11, 8)]]
    everything = batch(spark, [r for b in batches for r in b])
    write = latest_writer(path, ["k"], "ts", "id", 8)
    for n, b in enumerate(batches):
        write(batch(spark, b), n)
        write(batch(spark, b), n)
    got = {(r["k"], r["ts"], r["id"]) for r in rows(read_latest(spark, path, everything))}
    assert got == {(r["k"], r["ts"], r["id"]) for r in rows(latest_per_key(everything, ["k"], "ts", "id"))}


def test_only_touched_partitions_are_rewritten(spark):
    path = scratch_path(spark, "latest")
    merge_latest(batch(spark, [(f"m{i}", 1, i) for i in range(200)]), path, ["k"], "ts", "id", 16)
    files = lambda: {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    before = files()
    assert len(merge_latest(batch(spark, [("m3", 2, 999)]), path, ["k"], "ts", "id", 16)) == 1
    after = files()
    assert len(before - after) == len(after - before) == 1
    assert merge_latest(batch(spark, []), path, ["k"], "ts", "id", 16) == []
    table = read_latest(spark, path, batch(spark, []))
    assert table.count() == 200 and table.where("k = 'm3'").first()["id"] == 999


def test_replaced_versions_go_after_the_grace(spark):
    root = scratch_path(spark, "snap")
    for n in (1, 2, 3):
        maintenance.refresh_snapshot(spark, root, lambda n=n: spark.range(n))
    assert maintenance.expire_snapshots(spark, root) == []
    assert maintenance.expire_snapshots(spark, root, now=datetime.now() + timedelta(hours=2)) == [0, 1]
    assert maintenance.read_snapshot(spark, root).count() == 3
    assert maintenance.refresh_snapshot(spark, root, lambda: spark.range(4)).count() == 4


def test_an_upsert_keeps_one_row_a_key(spark):
    base, delta = batch(spark, [("a", 1, 1), ("b", 1, 2)]), batch(spark, [("a", 2, 3), ("a", 3, 4), ("c", 1, 5), ("c", 1, 5)])
    assert sorted((r["k"], r["id"]) for r in rows(ingest.upsert(base, delta, ["k"], "ts"))) == [("a", 4), ("b", 2), ("c", 5)]
    assert ingest.upsert(base, delta, ["k"]).count() == 3


def test_time_bounds_reach_the_scan(spark):
    for name in ("al20_disk_forecast", "al58_resource_forecast"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThan(ts" in plan, plan
    plan = QUERIES["al36_action_queue_top"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 0 or "GreaterThanOrEqual(ts" in plan
