"""When notifications of alert groups go out, in batch and as a stream."""
import random

import pytest
from helpers import at, frame, rows

from tallyforge.operators.notify import notifications
from tallyforge.session import scratch_path
from tallyforge.streaming.jobs import run_available
from tallyforge.streaming.ordered import notifications_stream

DDL = "device_id string, alertname string, device_type string, severity string, instance string, alert_id string, ts timestamp, firing boolean"
ROUTES = {"critical": (10, 300, 1800), "warning": (30, 600, 7200), "info": (30, 1800, 86400), "default": (30, 300, 14400)}


def changes(spark, spans):
    """spans: (id, alertname, severity, instance, device, begin, end or None)."""
    out = []
    for i, name, severity, instance, device, s, e in spans:
        row = {"device_id": device, "alertname": name, "device_type": "x", "severity": severity, "instance": instance, "alert_id": i}
        out += [{**row, "ts": at(s), "firing": True}] + ([{**row, "ts": at(e), "firing": False}] if e is not None else [])
    return frame(spark, DDL, out).repartition(3)


def told(df):
    return sorted((r["device_id"], r["alertname"], r["route"], r["ts"], r["reason"], r["n_firing"], r["n_resolved"]) for r in rows(df))


def brute(spans, until):
    """Every look at every group, worked out from the spans alone."""
    route = lambda s: s if s in ROUTES else "default"
    on = lambda a, t: a[5] <= t and (a[6] is None or a[6] > t)

    def implied(a, t):
        return any(
            on(b, t) and b[4] == a[4] and ((b[1] == "ServiceDown" and a[1] in ("ServiceHighLatency", "SLABreachWarning") and a[3] == b[3]) or (b[2] == "critical" and a[2] == "warning") or (b[1] == "InterfaceDown" and a[1] == "BandwidthSaturation"))
            for b in spans
        )

    out = []
    for device, name, r in {(a[4], a[1], route(a[2])) for a in spans}:
        own = [a for a in spans if (a[4], a[1], route(a[2])) == (device, name, r) and name != "Watchdog"]
        wait, interval, repeat = ROUTES[r]
        t = min((a[5] for a in own), default=until) + wait
        known, last = set(), None
        while t <= until:
            firing = {a[0] for a in own if on(a, t) and not implied(a, t)}
            gone = [i for i in known if not any(a[0] == i and on(a, t) for a in own)]
            reason = ("firing" if last is None else "changed") if firing - known else ("changed" if firing else "resolved") if gone else "repeat" if firing and t - last >= repeat else None
            if reason:
                out.append((device, name, r, at(t), reason, len(firing), len(gone)))
                known, last = firing, t
            if any(on(a, t) for a in own):
                t += interval
            else:
                known, last = set(), None
                t = min((a[5] for a in own if a[5] > t), default=until) + wait
    return sorted(out)


def test_one_group_from_burst_to_end(spark):
    spans = [("a", "Hot", "critical", "i", "d", 0, 4000), ("b", "Hot", "critical", "j", "d", 5, 100), ("c", "Hot", "critical", "k", "d", 400, 700), ("w", "Watchdog", "none", "i", "d", 0, None)]
    want = [(10, "firing", 2, 0), (310, "changed", 1, 1), (610, "changed", 2, 0), (910, "changed", 1, 1), (2710, "repeat", 1, 0), (4210, "resolved", 0, 1)]
    assert told(notifications(changes(spark, spans), at(9000))) == [("d", "Hot", "critical", at(t), *r) for t, *r in want]


def test_what_a_cause_implies_is_not_told(spark):
    spans = [("s", "ServiceDown", "critical", "i", "d", 0, 2000), ("l", "ServiceHighLatency", "info", "i", "d", 5, 9000), ("m", "ServiceHighLatency", "info", "other", "e", 5, 100), ("q", "Slow", "warning", "i", "d", 10, 1000)]
    got = told(notifications(changes(spark, spans), at(20_000)))
    assert got == brute(spans, 20_000)
    assert [r[3] for r in got if r[1] == "ServiceHighLatency" and r[0] == "d"][0] == at(5 + 30 + 3600) and not any(r[1] == "Slow" for r in got)


def many(seed, n=120):
    rng, out = random.Random(seed), []
    for i in range(n):
        s = rng.randint(0, 40_000)
        out.append((f"a{i:03d}", rng.choice(["ServiceDown", "ServiceHighLatency", "InterfaceDown", "BandwidthSaturation", "Other"]), rng.choice(["critical", "warning", "info", "odd"]), rng.choice("ij"), rng.choice(["d", "d", "e"]), s, rng.choice([None, s + rng.randint(1, 9000), s + rng.randint(1, 600)]) if i % 9 else s + 50))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_equals_looks_worked_out_one_by_one(spark, seed):
    spans = many(seed)
    assert told(notifications(changes(spark, spans), at(60_000))) == brute(spans, 60_000)


@pytest.mark.parametrize("cuts", [[], [10, 60, 61, 150]])
def test_the_stream_tells_the_same_and_leaves_nothing(spark, cuts):
    spans = [(*a[:6], a[6] or a[5] + 20_000) for a in many(3)]
    df = changes(spark, [*spans, ("z", "End", "critical", "z", "~", 200_000, None)])
    data = sorted(df.collect(), key=lambda r: (r["ts"], r["firing"], r["alert_id"]))
    path = scratch_path(spark, "alerts")
    for a, b in zip([0, *cuts], [*cuts, len(data)]):
        spark.createDataFrame(data[a:b], df.schema).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run_available(notifications_stream(source), "told")
    assert [r for r in told(got) if r[0] != "~"] == brute(spans, 190_000)


def test_no_alerts(spark):
    assert notifications(changes(spark, []), at(0)).count() == 0
