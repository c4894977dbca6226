import random
from datetime import timedelta

import pytest
from helpers import alarms, at, frame, rows, telemetry
from pyspark.sql import functions as F

from tallyforge import schema
from tallyforge.operators import joins, rca
from tallyforge.operators.alarms import link_alarms


@pytest.mark.parametrize("prune", [False, True])
def test_asof_against_brute_force(spark, prune):
    rnd = random.Random(7)
    tele = [{"eqp_id": rnd.choice(["hot"] * 8 + ["M2"]), "time": at(rnd.randrange(0, 6000))} for _ in range(300)]
    alrm = [{"equipmentid": rnd.choice(["hot", "M2", "M3"]), "logdate": at(rnd.randrange(0, 6000))} for _ in range(120)] + [{"equipmentid": None}] * 3
    t, a = telemetry(spark, tele), alarms(spark, alrm)
    near = {r["logid"]: r["hit"] for r in rows(joins.asof_nearest(a, t, "equipmentid", "logdate", "2 minutes", {"hit": "log_id"}, right_by="eqp_id", right_ts="time", prune=prune))}
    back = {r["logid"]: r["hit"] for r in rows(joins.asof_backward(a, t, "equipmentid", "logdate", "5 minutes", {"hit": "log_id"}, right_by="eqp_id", right_ts="time", prune=prune))}
    assert len(near) == len(alrm) == len(back)
    for i, al in enumerate(alrm):
        when = al.get("logdate", at(i))
        mine = [(x["time"], f"L{j:05d}") for j, x in enumerate(tele) if x["eqp_id"] == al["equipmentid"]]
        want = min(((abs(ts - when), ts, lid) for ts, lid in mine if abs(ts - when) <= timedelta(minutes=2)), default=(None, None, None))[2]
        assert near[f"A{i:05d}"] == want
        old = [(-(ts - when), lid) for ts, lid in mine if timedelta(0) <= when - ts <= timedelta(minutes=5)]
        assert back[f"A{i:05d}"] == min(old, default=(None, None))[1]


def test_exact_else_backward(spark):
    t = telemetry(spark, [{"log_id": "X", "time": at(0)}, {"log_id": "Y", "time": at(290)}, {"log_id": "Z", "time": at(1000)}])
    a = alarms(
        spark,
        [
            {"logdate": at(300), "related_log_id": "X"},  # exact, ten minutes back is enough
            {"logdate": at(300)},  # no id: last row of the machine
            {"logdate": at(700), "related_log_id": "X"},  # id too old: no fallback
            {"logdate": at(950), "related_log_id": "Z"},  # up to a minute ahead counts
            {"logdate": at(900)},  # nothing within five minutes
        ],
    )
    got = rows(joins.asof_exact_or_backward(a, t, {"hit": "log_id"}), "logid")
    assert [(r["hit"], r["match_type"]) for r in got] == [("X", "exact"), ("Y", "nearest"), (None, None), ("Z", "exact"), (None, None)]


def test_lift_uses_unrounded_shares(spark):
    # 1 hot row in 5000: the baseline rounds to 0.0 but the lift must not vanish
    tele = telemetry(spark, [{"temperature": 30.0 if i == 0 else 22.0, "humidity": 55.0, "pe_1": 1.0, "je_1": 1.0, "scan_speed": 100.0, "air_vacuum": -10.0, "resist_dosage": 1.0} for i in range(5000)])
    al = alarms(spark, [{"logdate": at(1), "related_log_id": "L00000"}] * 30 + [{"logdate": at(1), "errorcode": "70004", "related_log_id": "L00001"}] * 29)
    cat = frame(spark, schema.CATALOG, [{"alarm_id": c, "alarm_code": c} for c in ("91008", "70004", "91009")])
    out = {r["alarm_category"]: r for r in rows(rca.rca_lift(rca.alarm_context(al, cat, tele), rca.alarm_category(cat), tele, None, None))}
    thermal, motion, vac = out["THERMAL (91008)"], out["MOTION (70004)"], out["VACUUM (91009)"]
    assert thermal["baseline_pct"] == 0.0 and thermal["lift"] == 5000.0 and thermal["confidence"] == "OK"
    assert motion["lift"] is None and motion["event_count"] == 29 and motion["confidence"].startswith("LOW")
    assert vac["event_count"] == 0 and vac["alarm_window_pct"] is None


def test_link_alarms(spark):
    t = telemetry(spark, [{"time": at(0)}, {"time": at(200)}])
    a = alarms(spark, [{"logdate": at(90)}, {"logdate": at(1000)}, {"logdate": at(0), "related_log_id": "L00001"}, {"logdate": at(0), "related_log_id": "gone"}])
    ok, bad = link_alarms(a, t)
    assert [(r["related_log_id"], r["link_basis"]) for r in rows(ok, "logid")] == [("L00000", "nearest"), (None, None), ("L00001", "causal")]
    assert [r["logid"] for r in rows(bad)] == ["A00003"]


def test_bounded_join_and_scalar(spark):
    t = telemetry(spark, [{"temperature": 20.0}, {"temperature": 24.0}])
    base = t.agg(F.avg("temperature").alias("b"))
    assert [r["b"] for r in rows(joins.with_scalar(t, base, ["b"]))] == [22.0, 22.0]
