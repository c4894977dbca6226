import statistics as st

import pytest
from helpers import T0, at, frame, rows, telemetry

from tallyforge import schema
from tallyforge.operators import control, spc

PE = [2, 3, 1, 4, 2, 3, 2, 4, 3, 2, 3, 1]
JE = [5, 7, 4, 8, 5, 7, 5, 8]


def golden(spark, pe=True, je=True, **extra):
    out = []
    for i in range(2):
        r = {"pe_setting": 4.0, "je_setting": 6.0, **extra}
        if pe:
            r |= {f"pe_{j + 1}": float(PE[i * 6 + j]) for j in range(6)}
        if je:
            r |= {f"je_{j + 1}": float(JE[i * 4 + j]) for j in range(4)}
        out.append(r)
    return out


def cpk(xs, limit):
    mu, s = st.mean(xs), st.stdev(xs)
    return min((limit - mu) / (3 * s), (mu + limit) / (3 * s))


def test_golden_capability(spark):
    t = telemetry(spark, golden(spark))
    r = rows(spc.spc_ranking(t))[0]
    assert r["sample_count"] == 12 and r["sample_count_je"] == 8
    assert r["mean_pe"] == pytest.approx(st.mean(PE), abs=0.02) and r["stddev_pe"] == pytest.approx(st.stdev(PE), abs=0.02)
    assert r["cpk"] == pytest.approx(cpk(PE, 4), abs=0.02) and r["cpk_je"] == pytest.approx(cpk(JE, 6), abs=0.02)


def test_pe_only_je_only_and_sentinel_setting(spark):
    t = telemetry(
        spark,
        [{**r, "eqp_id": "PE"} for r in golden(spark, je=False)] + [{**r, "eqp_id": "JE"} for r in golden(spark, pe=False)]
        + [{**r, "eqp_id": "NONE"} for r in golden(spark, pe_setting=2.0, je_setting=1.0)] + [{"eqp_id": "FLAT", "pe_1": 3.0}, {"eqp_id": "FLAT", "pe_1": 3.0}],
    )
    got = {r["eqp_id"]: r for r in rows(spc.spc_ranking(t))}
    assert set(got) == {"PE", "JE"}
    assert got["PE"]["cpk_je"] is None and got["JE"]["cpk"] is None


def test_fleet_keeps_silent_machines(spark):
    t = telemetry(spark, golden(spark))
    devices = frame(spark, schema.DEVICES, [{"device_id": d, "device_type": ty, "enabled": on} for d, ty, on in (("M1", "ldi", True), ("M2", "ldi", True), ("M3", "ldi", False), ("S1", "server", True))])
    got = {r["eqp_id"]: r for r in rows(spc.cpk_confidence(spc.spc_fleet(t, devices, at(60))))}
    assert set(got) == {"M1", "M2"}
    assert got["M2"]["worst_cpk"] is None and got["M2"]["confidence"] == "NO_DATA"
    assert got["M1"]["worst_cpk"] == pytest.approx(min(cpk(PE, 4), cpk(JE, 6)), abs=0.02) and got["M1"]["confidence"] == "LOW SAMPLE (n<30)"


def series(spark, xs, eqp="M1"):
    return telemetry(spark, [{"eqp_id": eqp, "pe_1": float(x)} for x in xs])


@pytest.mark.parametrize("max_rows", [None, 45])
def test_nelson_rules(spark, max_rows):
    xs = [5.0, 6.0] * 20 + [9.0, 9.5, 10.0, 10.5, 11.0, 11.5, 12.0] + [5.5] * 3
    got = rows(control.nelson_rules(series(spark, xs), max_rows=max_rows), "time")
    assert got[0]["rule1_beyond_3sigma"] == 0 and got[0]["sigma"] is None
    assert all(r["any_rule_triggered"] == 0 for r in got[:8])
    # the rise from 5 to 6 before the ramp counts, so 11.0 ends six rises in a row
    assert [r["avg_pe"] for r in got if r["rule3_six_trend"] == 1] == [11.0, 11.5, 12.0]
    assert got[40]["rule1_beyond_3sigma"] == 1


@pytest.mark.parametrize("max_rows", [None, 7, 3])
def test_ewma_and_cusum_follow_the_recurrence(spark, max_rows):
    xs = [((i * 37) % 23) / 2.0 for i in range(60)]
    z, pos, neg, want = None, 0.0, 0.0, []
    for x in xs:
        z = x if z is None else 0.2 * x + 0.8 * z
        pos, neg = max(0.0, pos + x - 5 - 0.5), max(0.0, neg + 5 - x - 0.5)
        want.append((round(z, 3), round(pos, 3), round(neg, 3)))
    t = series(spark, xs)
    e = rows(control.ewma(t, max_rows=max_rows), "time")
    c = rows(control.cusum(t, target=5.0, max_rows=max_rows), "time")
    for (wz, wp, wn), re_, rc in zip(want, e, c):
        assert re_["ewma_value"] == pytest.approx(wz, abs=0.0011)
        assert rc["cusum_pos"] == pytest.approx(wp, abs=0.0011) and rc["cusum_neg"] == pytest.approx(wn, abs=0.0011)
        assert rc["alarm"] == (wp > 10 or wn > 10)


def test_yield_and_stability(spark):
    t = telemetry(spark, [{"pe_1": 1.0, "je_1": 1.0}, {"pe_1": 20.0, "je_1": 1.0}, {"temperature": 22.0, "eqp_id": "M2"}])
    y = rows(spc.yield_pct(t, T0, at(100)))[0]
    assert (y["pe_yield"], y["je_yield"], y["yield_pct"]) == (50.0, 100.0, 50.0)
    s = {r["eqp_id"]: r for r in rows(spc.process_stability(t))}
    assert s["M2"]["pe_score"] == 0.0 and s["M2"]["temp_score"] == 0.0 and set(s) == {"M1", "M2"}
