import pytest
from helpers import T0, alarms, at, frame, rows, telemetry
from pyspark.sql import functions as F

from tallyforge import schema
from tallyforge.operators import alarms as al
from tallyforge.operators import rca


def test_severity(spark):
    df = spark.createDataFrame([("Emergency stop", "A"), ("x", "e "), ("x", "W"), ("Timeout on axis", "A"), ("other", "A"), ("hyperacceleration", "W")], "alarm_msg string, alarm_type string").withColumn("alarm_detail", F.lit("NULL"))
    got = rows(al.with_severity(df))
    assert [r["severity"] for r in got] == ["Critical", "Critical", "Warning", "Minor", "Major", "Critical"] and got[0]["alarm_detail"] is None


def catalog(spark):
    return frame(spark, schema.CATALOG, [{"alarm_id": "91008", "alarm_code": "91008", "severity": "Critical", "alarm_msg": "env"}, {"alarm_id": "77", "alarm_code": "77", "severity": "Minor", "alarm_msg": "m"}])


def test_action_queue_and_empty_row(spark):
    cat, tele = catalog(spark), telemetry(spark, [{}])
    life = frame(spark, schema.LIFECYCLE, [{"logid": "A00001", "logdate": at(1), "status": "RESOLVED"}])
    a = alarms(spark, [{"factory": "9", "related_log_id": "L00000"}, {}, {"errorcode": "77"}])
    got = rows(al.action_queue(a, cat, tele, life, rca.alarm_category(cat), at(130)))
    assert [(r["logid"], r["owner"], r["action"], r["factory"], r["elapsed"]) for r in got] == [("A00000", "Facility", "CHECK HVAC", "1", "2m")]
    empty = rows(al.action_queue(a, cat, tele, life, rca.alarm_category(cat), at(9999)))
    assert len(empty) == 1 and empty[0]["severity"] == "NONE" and empty[0]["when_ms"] == 0


@pytest.mark.parametrize("max_rows", [None, 10, 2])
def test_debounce(spark, max_rows):
    # a flood without a quiet period, another code, and a key that goes quiet
    a = alarms(spark, [{"logdate": at(60 * i)} for i in range(40)] + [{"errorcode": "x", "logdate": at(0)}, {"errorcode": "x", "logdate": at(720)}, {"errorcode": "x", "logdate": at(1439)}])
    out = al.debounce(a, max_rows=max_rows)
    fired = {(r["errorcode"], r["logdate"]) for r in rows(out.where("fired"))}
    assert fired == {("91008", at(60 * i)) for i in (0, 12, 24, 36)} | {("x", at(0)), ("x", at(720))}
    assert out.count() == 43
    st = {r["errorcode"]: r for r in rows(al.debounce_state(out))}
    assert st["91008"]["fire_count"] == 4 and st["91008"]["last_fired"] == at(2160)


def actions(spark, items):
    ddl = schema.ACTIONS + ", action_id STRING"
    return frame(spark, ddl, [{"logid": i, "logdate": T0, "action": a, "actor": who, "action_ts": at(n), "action_id": f"{n:03d}"} for n, (i, a, who) in enumerate(items)])


ITEMS = [("a", "ACKNOWLEDGED", "ann"), ("a", "RESOLVED", "bob"), ("a", "ACKNOWLEDGED", "eve"), ("b", "ACKNOWLEDGED", " "), ("b", "RESOLVED", "bob"), ("c", "OPEN", "x"), ("c", "ACKNOWLEDGED", "x"), ("c", "ACKNOWLEDGED", "y"), ("zz", "RESOLVED", "x")]
REASONS = {"002": "RESOLVED is final", "003": "actor required", "005": "no transition to OPEN", "007": "not OPEN", "008": "unknown alarm"}


def test_lifecycle_fold(spark):
    a = alarms(spark, [{"logid": i, "logdate": T0} for i in "abcd"])
    state, bad = al.lifecycle_fold(a, actions(spark, ITEMS))
    got = {r["logid"]: r for r in rows(state)}
    assert {k: v["status"] for k, v in got.items()} == {"a": "RESOLVED", "b": "RESOLVED", "c": "ACKNOWLEDGED", "d": "OPEN"}
    assert got["a"]["acknowledged_by"] == "ann" and got["a"]["resolved_by"] == "bob" and got["b"]["acknowledged_at"] is None and got["d"]["updated_at"] == T0
    assert {r["action_id"]: r["reason"] for r in rows(bad)} == REASONS


def test_sustained(spark):
    evals = spark.createDataFrame([("k", at(60 * i), i not in (3, 9)) for i in range(12) if i != 7], "key string, ts timestamp, cond boolean")
    got = [r["state"] for r in rows(al.sustained(evals, ["key"], "2 minutes", "1 minute"), "ts")]
    # minute 7 is missing, so the run restarts at 8
    assert got == ["pending", "pending", "firing", "ok", "pending", "pending", "firing", "pending", "ok", "pending", "pending"]


def test_inhibit(spark):
    df = spark.createDataFrame(
        [(1, "ServiceDown", "critical", "d1", "i1"), (2, "ServiceHighLatency", "info", "d9", "i1"), (3, "Other", "warning", "d1", "i2"), (4, "InterfaceDown", "info", "d2", "i3"), (5, "BandwidthSaturation", "info", "d2", "i4"), (6, "Other", "warning", "d3", "i5")],
        "n int, alertname string, severity string, device_id string, instance string",
    )
    assert [r["n"] for r in rows(al.inhibit(df), "n")] == [1, 4, 6]
