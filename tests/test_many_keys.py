"""Work that grows with the rows, not with a call, a shuffle or a pass for each key, step or rule."""
import numpy as np
import pytest
from helpers import at, frame

from tallyforge.operators import infra, recurrences, snapshot
from tallyforge.session import scratch_path
from tallyforge.streaming import jobs, keyed, ordered


def state_rows(spark, df, name, build):
    path = scratch_path(spark, name)
    df.write.parquet(path)
    q = build(spark.readStream.schema(df.schema).parquet(path)).writeStream.format("noop")
    q = q.option("checkpointLocation", scratch_path(spark, f"{name}-ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress)


def test_many_keys_share_the_calls_of_a_stream(spark):
    n = keyed.BUCKETS + 2000
    keys = spark.range(n).selectExpr("CAST(id AS string) AS equipmentid", "'x' AS errorcode", "timestamp'2024-01-01' AS logdate", "CAST(id AS string) AS logid")
    assert state_rows(spark, keys, "many-deb", jobs.debounce_stream) <= keyed.BUCKETS
    polls = keys.selectExpr("equipmentid AS device_id", "logdate AS ts", "'cpu' AS walker", "1.0D AS cpu")
    assert state_rows(spark, polls, "many-polls", lambda s: ordered.poll_cycles_stream(s, "1 hour")) <= keyed.BUCKETS


def test_keys_with_nulls_and_long_numbers_stay_apart(spark):
    big = (1 << 60) + 1
    ddl = "equipmentid string, errorcode bigint, logdate timestamp, logid string"
    df = frame(spark, ddl, [{"equipmentid": e, "errorcode": c, "logdate": at(s), "logid": f"L{s}"} for e in ("M", None) for c in (big, big + 1, None) for s in (0, 1, 900)])
    path = scratch_path(spark, "nulls")
    df.write.parquet(path)
    got = jobs.run_available(jobs.debounce_stream(spark.readStream.schema(df.schema).parquet(path)), "nulls").collect()
    want = {(e, c, f"L{s}", n) for e in ("M", None) for c in (big, big + 1, None) for s, n in ((0, 1), (900, 2))}
    assert len(got) == len(want) and {(r["equipmentid"], r["errorcode"], r["logid"], r["fire_count"]) for r in got} == want


def test_a_grid_is_laid_out_after_its_join(spark):
    tele = frame(spark, "eqp_id string, time timestamp, log_id string, state boolean", [{"eqp_id": "M1", "time": at(s), "log_id": str(s), "state": v} for s, v in ((0, True), (10, False), (3600, True), (7300, None), (90, True))])
    devices = frame(spark, "device_id string, device_type string, enabled boolean", [{"device_id": d, "device_type": "ldi", "enabled": True} for d in ("M1", "M1", "M2", None)])
    got = snapshot.state_grid(tele, devices, "2024-03-01 08:00:00", "2024-03-05 00:00:00", "1 minute")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
    rows = got.collect()
    assert len(rows) == 4 * 88 * 60 and len({(r["eqp_id"], r["bucket"]) for r in rows}) == 3 * 88 * 60
    told = sorted((r["bucket"], r["state"]) for r in rows if r["state"] != "NO_DATA")
    assert told == sorted([(at(0), "IDLE"), (at(60), "RUNNING"), (at(3600), "RUNNING")] * 2)
    # steps that do not fall on the buckets meet none
    assert {r["state"] for r in snapshot.state_grid(tele, devices, "2024-03-01 07:59:30", "2024-03-01 09:00:00", "1 minute").collect()} == {"NO_DATA"}


def test_rules_over_the_same_windows_share_a_pass(spark, monkeypatch):
    calls, own = [], infra.sustained
    monkeypatch.setattr(infra, "sustained", lambda *a, **k: calls.append(1) or own(*a, **k))
    rows = [{"time": at(60 * i), "device_id": "D", "cpu_load_percent": 99.0 if i < 30 else 1.0, "ram_total_mb": 10.0, "ram_used_mb": 9.9, "disk_total_gb": 10.0, "disk_used_gb": None, "temp_c": 99.0 if i % 10 else 1.0} for i in range(60)]
    tele = frame(spark, "time timestamp, device_id string, cpu_load_percent double, ram_total_mb double, ram_used_mb double, disk_total_gb double, disk_used_gb double, temp_c double", rows)
    got = infra.sustained_alerts(tele, infra.SYS_RULES, step="1 minute", window="1 minute", hold="5 minutes").collect()
    assert len(calls) == 1
    n = {r: sum(x["rule"] == r for x in got) for r in ("cpu_high", "ram_high", "disk_high", "temp_high")}
    assert n == {"cpu_high": 25, "ram_high": 55, "disk_high": 0, "temp_high": 24}


def test_short_histories_need_no_pandas(monkeypatch):
    v = np.array([4.0, 2.0, 2.0, 8.0])
    want = [recurrences.level_after(np.append(v, np.zeros(100)), z, 0.3)[:4].tolist() for z in (None, 1.0)]
    monkeypatch.setattr(recurrences.pd, "Series", lambda *a, **k: pytest.fail("pandas"))
    assert [recurrences.level_after(v, z, 0.3).tolist() for z in (None, 1.0)] == want
