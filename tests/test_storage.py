from helpers import T0, at, rows, telemetry
from pyspark.sql import functions as F

from tallyforge.operators import rollup
from tallyforge.session import scratch_path
from tallyforge.sources import ingest, maintenance


def test_json_coercion(spark):
    lines = [
        '[{"eqp_id":"M1","temperature":0,"humidity":"abc","state":false,"board_no":"12 of 40","resist":"","log_id":7},{"eqp_id":""},{"temperature":1}]',
        '{"eqp_id":"M2","temperature":"21.5","state":null}',
    ]
    got = rows(ingest.ingest_telemetry(spark.createDataFrame([(x,) for x in lines], "value string")), "eqp_id")
    assert [r["eqp_id"] for r in got] == ["M1", "M2"]
    assert (got[0]["temperature"], got[0]["humidity"], got[0]["state"], got[0]["board_no"], got[0]["resist"], got[0]["log_id"]) == (0.0, None, False, 12, None, "7")
    assert (got[1]["temperature"], got[1]["state"], got[1]["mo"]) == (21.5, True, "")


def test_container_events(spark):
    lines = [
        '{"Action":"die","time":1700000000,"Actor":{"Attributes":{"name":"db"}}}', '{"Action":"exec_die","time":1,"Actor":{"Attributes":{"name":"db"}}}',
        '{"Action":"kill","time":1,"Actor":{"Attributes":{}}}', '{"Action":"oom","Actor":{"Attributes":{"name":"db"}}}', "not json",
    ]
    got = rows(ingest.ingest_container_events(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert [(r["container_name"], r["event_action"], r["raw_event"]) for r in got] == [("db", "die", lines[0])]


def hourly(df):
    return rollup.drop_counts(rollup.rollup(df, "time", "1 hour", ["eqp_id"], {"avg_t": ("avg", "temperature")}))


def test_refresh_changes_only_its_window(spark):
    path = scratch_path(spark, "t-rollup")
    first = telemetry(spark, [{"time": at(3600 * i), "temperature": 20.0} for i in range(30)])
    maintenance.refresh_rollup(first, path, hourly, "time", "1 hour", at(3600 * 30), "60 days", "0 seconds")
    # every reading is corrected, but only four hours are re-opened and the last one is still settling
    fixed = first.withColumn("temperature", F.lit(25.0))
    out = maintenance.refresh_rollup(fixed, path, hourly, "time", "1 hour", at(3600 * 30), "4 hours", "1 hour")
    got = {r["bucket"]: r["avg_t"] for r in rows(out)}
    assert len(got) == 30
    assert [i for i in range(30) if got[at(3600 * i)] == 25.0] == [26, 27, 28]


def test_realtime_counts_a_bucket_once(spark):
    t = telemetry(spark, [{"time": at(1800 * i), "temperature": float(i)} for i in range(10)])
    out = maintenance.realtime_rollup(hourly(t), t, hourly, "time", at(3600 * 3))
    assert sorted((r["bucket"], r["sample_count"]) for r in rows(out)) == [(at(3600 * i), 2) for i in range(5)]


def test_ledger_failure_and_replay(spark):
    root = scratch_path(spark, "t-ledger")
    batch = telemetry(spark, [{}] * 5).select("time", "log_id")

    def refuse(df, batch_id):
        raise OSError("down")

    written = []
    assert maintenance.stage_batch(batch, 1, "telemetry", f"{root}/l", f"{root}/p", "time", refuse) == "failed"
    assert maintenance.stage_batch(batch, 2, "telemetry", f"{root}/l", f"{root}/p", "time", lambda d, i: written.append(d.count())) == "committed"
    assert maintenance.replay(spark, f"{root}/l", f"{root}/p", "time", lambda d, i: written.append(d.count())) == 1
    state = {r["batch_id"]: r for r in rows(maintenance.ledger_state(spark.read.schema(maintenance.LEDGER).parquet(f"{root}/l")))}
    assert written == [5, 5] and {i: s["status"] for i, s in state.items()} == {1: "committed", 2: "committed"} and state[1]["attempts"] == 2
    assert maintenance.replay(spark, f"{root}/l", f"{root}/p", "time", lambda d, i: None) == 0


def test_partition_pruning_reaches_the_scan(spark):
    path = scratch_path(spark, "t-layout")
    t = telemetry(spark, [{"time": at(86400 * i)} for i in range(6)])
    maintenance.write_partitioned(t, path, "time", "1 day")
    from tallyforge.functions import last

    df = last(spark.read.parquet(path), "time", "2 days", at(86400 * 5), date_col="date").select("log_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [IsNotNull(time), GreaterThan(time" in plan
    assert df.count() == 2


def test_cascade_totals(spark):
    t = telemetry(spark, [{"time": at(13 * i), "temperature": float(i % 7)} for i in range(900)])
    exact = rows(t.agg(F.avg("temperature").alias("a")))[0]["a"]
    for grain in ("1m", "15m", "1h"):
        got = rollup.telemetry_rollup(t, grain, "weighted").agg(F.sum("sample_count").alias("n"), (F.sum(F.col("avg_temperature") * F.col("sample_count")) / F.sum("sample_count")).alias("a")).first()
        assert got.n == 900 and abs(got.a - exact) < 1e-9
    assert rollup.tier_for(T0, at(6 * 3600)) == "1m" and rollup.tier_for(T0, at(48 * 3600)) == "15m" and rollup.tier_for(T0, at(48 * 3600 + 1)) == "1h"


def test_append_is_idempotent(spark):
    new = telemetry(spark, [{}, {}]).select("time", "log_id")
    once = ingest.append_idempotent(new.unionByName(new), new.limit(0), ["log_id", "time"])
    assert once.count() == 2 and ingest.append_idempotent(new, once, ["log_id", "time"]).count() == 0


def test_a_batch_written_twice_counts_once(spark):
    root = scratch_path(spark, "t-sink")
    batch, sink = telemetry(spark, [{}] * 4).select("time", "log_id"), maintenance.batch_sink(f"{root}/table")

    def lost(df, batch_id):
        sink(df, batch_id)
        raise OSError("lost after the write")

    assert maintenance.stage_batch(batch, 7, "t", f"{root}/l", f"{root}/p", "time", lost) == "failed"
    assert maintenance.replay(spark, f"{root}/l", f"{root}/p", "time", sink) == 1
    assert spark.read.parquet(f"{root}/table").count() == 4


def test_retention_removes_directories(spark):
    path = scratch_path(spark, "t-keep")
    maintenance.write_partitioned(telemetry(spark, [{"time": at(86400 * i)} for i in range(6)]), path, "time", "1 day")
    gone = maintenance.drop_expired(spark, path, "2 days", at(86400 * 5))
    assert gone.count() == 3 and spark.read.parquet(path).count() == 3
    assert maintenance.drop_expired(spark, path, "2 days", at(86400 * 5)).count() == 0


def test_a_snapshot_is_current_once_complete(spark):
    root = scratch_path(spark, "t-snap")
    first = maintenance.refresh_snapshot(spark, root, lambda: spark.range(3))
    # a version whose job never committed is no version
    spark.range(9).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/version=1")
    assert maintenance.read_snapshot(spark, root).count() == 3
    assert maintenance.refresh_snapshot(spark, root, lambda: spark.range(5)).count() == 5 and first.count() == 3
