"""Capability, control charts, root cause, snapshots, infrastructure health and rollups."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import control, infra, rca, rollup, snapshot, spc
from ..schema import JE_COLS, PE_COLS
from ..session import scratch_path
from ..sources import maintenance
from ..sources.latest import merge_latest, read_latest
from .basics import _ABS_JE, _ABS_PE, _ABS_PE0, _W, CLASS_SQL, FLAGS_SQL, TINY, UNPIVOT_PE, cascade_sql
from .registry import query, r, seconds
from .tables import AS_OF, CATEGORY_SQL, Tables

_A = f"TIMESTAMP '{AS_OF}'"


def _cap_sql(name: str, cols: list[str], setting: str, keys: str, where: str = "true") -> str:
    """CTEs <name>: n, passed, mu, sigma, cp, cpk of the unpivoted samples."""
    return (
        f"{name}_u AS (SELECT {keys}, coalesce({setting}, 25.0) AS lim, unnest([{', '.join(cols)}]) AS x FROM tele WHERE {cols[0]} IS NOT NULL AND coalesce({setting}, 0) > 2.0 AND {where}), "
        f"{name}_s AS (SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE abs(x) <= lim) AS passed, avg(x) AS mu, stddev_samp(x) AS sigma, avg(lim) AS st FROM {name}_u WHERE x IS NOT NULL GROUP BY ALL), "
        f"{name} AS (SELECT *, st / NULLIF(3 * sigma, 0) AS cp, least((st - mu) / NULLIF(3 * sigma, 0), (mu + st) / NULLIF(3 * sigma, 0)) AS cpk FROM {name}_s)"
    )


_KEYS = "eqp_id, factory, mo, fpn, layer_name"


def _ranking_sql(where: str) -> str:
    keys = ", ".join(f"coalesce(p.{k}, j.{k}) AS {k}" for k in _KEYS.split(", "))
    on = " AND ".join(f"p.{k} = j.{k}" for k in _KEYS.split(", "))
    return (
        f"WITH {_cap_sql('p', PE_COLS, 'pe_setting', _KEYS, where)}, {_cap_sql('j', JE_COLS, 'je_setting', _KEYS, where)}, "
        f"rk AS (SELECT {keys}, p.n AS sample_count, {r('p.mu', 3)} AS mean_pe, {r('p.sigma', 3)} AS stddev_pe, {r('p.cp', 3)} AS cp, {r('p.cpk', 3)} AS cpk, {CLASS_SQL.format(c='p.cpk')} AS capability_class, "
        f"j.n AS sample_count_je, {r('j.mu', 3)} AS mean_je, {r('j.sigma', 3)} AS stddev_je, {r('j.cp', 3)} AS cp_je, {r('j.cpk', 3)} AS cpk_je, {CLASS_SQL.format(c='j.cpk')} AS capability_class_je "
        f"FROM p FULL OUTER JOIN j ON {on} WHERE coalesce(p.sigma, j.sigma) > 0)"
    )


@query("al1_spc_ranking", "tele", _ranking_sql("true") + " SELECT * FROM rk")
def _(t: Tables) -> DataFrame:
    return spc.spc_ranking(t.tele, hours=None)


@query("al1_spc_ranking_recent", "tele", _ranking_sql("time > (SELECT max(time) - INTERVAL 72 HOUR FROM tele)") + " SELECT * FROM rk")
def _(t):
    return spc.spc_ranking(t.tele, hours=72)


_FLEET = (
    f"WITH {_cap_sql('p', PE_COLS, 'pe_setting', 'eqp_id', f'time > {_A} - INTERVAL 720 HOUR')}, {_cap_sql('j', JE_COLS, 'je_setting', 'eqp_id', f'time > {_A} - INTERVAL 720 HOUR')}, "
    f"fl AS (SELECT d.device_id AS eqp_id, d.location, p.n AS n_pe, {r('p.cp', 3)} AS cp_pe, {r('p.cpk', 3)} AS cpk_pe, {r('100.0 * p.passed / p.n', 1)} AS pe_pass_rate, j.n AS n_je, {r('j.cp', 3)} AS cp_je, "
    f"{r('j.cpk', 3)} AS cpk_je, {r('100.0 * j.passed / j.n', 1)} AS je_pass_rate, {r('CASE WHEN p.cpk IS NULL THEN j.cpk WHEN j.cpk IS NULL THEN p.cpk ELSE least(p.cpk, j.cpk) END', 3)} AS worst_cpk, "
    "CASE WHEN p.cpk IS NULL THEN j.n WHEN j.cpk IS NULL THEN p.n WHEN p.cpk <= j.cpk THEN p.n ELSE j.n END AS worst_n "
    "FROM devices d LEFT JOIN p ON p.eqp_id = d.device_id LEFT JOIN j ON j.eqp_id = d.device_id WHERE d.device_type = 'ldi' AND d.enabled)"
)


@query("al2_spc_fleet", "tele devices", _FLEET + " SELECT * FROM fl")
def _(t):
    return spc.spc_fleet(t.tele, t.devices, AS_OF, hours=720)


@query("al4_cpk_confidence", "tele devices", _FLEET + " SELECT eqp_id, worst_cpk, CASE WHEN worst_cpk IS NULL THEN 'NO_DATA' WHEN coalesce(worst_n, 0) < 30 THEN 'LOW SAMPLE (n<30)' ELSE 'OK' END AS confidence FROM fl")
def _(t):
    return spc.cpk_confidence(spc.spc_fleet(t.tele, t.devices, AS_OF, hours=720)).select("eqp_id", "worst_cpk", "confidence")


_CPK = "least((st - mu) / NULLIF(3 * sigma, 0), (mu + st) / NULLIF(3 * sigma, 0))"


@query(
    "al3_max_error_capability", "tele",
    f"WITH s AS (SELECT eqp_id, count(*) AS n, avg({_ABS_PE0}) AS mu, stddev_samp({_ABS_PE0}) AS sigma, avg(coalesce(pe_setting, 25.0)) AS st FROM tele WHERE pe_1 IS NOT NULL AND time >= {_A} - INTERVAL 43200 MINUTE GROUP BY 1) "
    f"SELECT eqp_id, n AS sample_count, {r('mu', 3)} AS mean_pe, {r('sigma', 3)} AS stddev_pe, {r('st * 2 / (6 * sigma)', 3)} AS cp, {r(_CPK, 3)} AS cpk, {r(f'2 * {_CPK} + 1.5', 2)} AS sigma_level, {r('st', 1)} AS spec_upper, {r('-st', 1)} AS spec_lower FROM s WHERE sigma > 0",
)
def _(t):
    return spc.max_error_capability(t.tele, AS_OF, minutes=43200)


@query(
    "al5_yield_pct", "tele",
    f"WITH y AS (SELECT {r(f'100.0 * count(*) FILTER (WHERE {_ABS_PE} <= pe_setting) / NULLIF(count(pe_1), 0)', 1)} AS pe_yield, {r(f'100.0 * count(*) FILTER (WHERE {_ABS_JE} <= je_setting) / NULLIF(count(je_1), 0)', 1)} AS je_yield "
    f"FROM tele WHERE time BETWEEN TIMESTAMP '2024-01-01' AND {_A}) SELECT *, coalesce(least(pe_yield, je_yield), pe_yield, je_yield) AS yield_pct FROM y",
)
def _(t):
    return spc.yield_pct(t.tele, "2024-01-01", AS_OF)


_EWMA = (
    f"WITH RECURSIVE s AS (SELECT time, eqp_id, log_id, {_ABS_PE0} AS x, row_number() OVER ({_W}) AS rn FROM (SELECT * FROM (tele_) WHERE pe_1 IS NOT NULL)), "
    "z AS (SELECT eqp_id, rn, log_id, time, x, x AS z FROM s WHERE rn = 1 UNION ALL SELECT s.eqp_id, s.rn, s.log_id, s.time, s.x, 0.2 * s.x + 0.8 * z.z FROM z JOIN s ON s.eqp_id = z.eqp_id AND s.rn = z.rn + 1) "
    f"SELECT time, eqp_id, log_id, {r('x', 3)} AS raw_value, {r('z', 3)} AS ewma_value, CAST(8.333 AS DOUBLE) AS ucl, CAST(-8.333 AS DOUBLE) AS lcl FROM z"
)


def _tele_inline(sql: str) -> str:
    from .tables import view_sql

    return sql.replace("tele_", view_sql("tele"))


@query("al6_ewma", "", _tele_inline(_EWMA).replace("WITH RECURSIVE", "with recursive"))
def _(t):
    return control.ewma(t.tele)


@query("al6_ewma_split", same_as="al6_ewma")
def _(t):
    return control.ewma(t.tele, max_rows=16)


_CUSUM = (
    f"WITH s AS (SELECT time, eqp_id, log_id, {_ABS_PE0} AS x FROM tele WHERE pe_1 IS NOT NULL), "
    f"p AS (SELECT *, sum(x - 5 - 0.5) OVER w AS su, sum(5 - x - 0.5) OVER w AS sd FROM s WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)), "
    f"c AS (SELECT *, su - least(0, min(su) OVER w) AS cp, sd - least(0, min(sd) OVER w) AS cn FROM p WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)) "
    f"SELECT time, eqp_id, log_id, {r('x', 3)} AS raw_value, {r('cp', 3)} AS cusum_pos, {r('cn', 3)} AS cusum_neg, ({r('cp', 3)} > 10 OR {r('cn', 3)} > 10) AS alarm FROM c"
)


@query("al7_cusum", "tele", _CUSUM)
def _(t):
    return control.cusum(t.tele, target=5.0)


@query("al7_cusum_split", same_as="al7_cusum")
def _(t):
    return control.cusum(t.tele, target=5.0, max_rows=16)


@query(
    "al7_cusum_one_lag", "tele",
    f"WITH s AS (SELECT time, eqp_id, log_id, {_ABS_PE0} AS x FROM tele WHERE pe_1 IS NOT NULL), "
    f"c AS (SELECT *, greatest(0, x - 5.5) + coalesce(lag(greatest(0, x - 5.5)) OVER w, 0) AS cp, greatest(0, 4.5 - x) + coalesce(lag(greatest(0, 4.5 - x)) OVER w, 0) AS cn FROM s WINDOW w AS ({_W})) "
    f"SELECT time, eqp_id, log_id, {r('x', 3)} AS raw_value, {r('cp', 3)} AS cusum_pos, {r('cn', 3)} AS cusum_neg, ({r('cp', 3)} > 10 OR {r('cn', 3)} > 10) AS alarm FROM c",
)
def _(t):
    return control.cusum(t.tele, target=5.0, mode="one_lag")


_NELSON = (
    f"WITH s AS (SELECT time, eqp_id, log_id, {_ABS_PE0} AS x FROM tele WHERE pe_1 IS NOT NULL), "
    f"m AS (SELECT *, avg(x) OVER w AS mu, stddev_samp(x) OVER w AS sigma, x - lag(x) OVER ({_W}) AS delta FROM s WINDOW w AS ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), "
    f"d AS (SELECT *, CAST(sign({r('x - mu', 6)}) AS INTEGER) AS side, CASE WHEN delta > 0 THEN 1 WHEN delta < 0 THEN -1 ELSE 0 END AS mv FROM m), "
    f"q AS (SELECT *, sum(side) OVER ({_W} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS s9, sum(mv) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS m6 FROM d), "
    "f AS (SELECT *, CASE WHEN sigma > 0 AND (x > mu + 3 * sigma OR x < mu - 3 * sigma) THEN 1 ELSE 0 END AS r1, CASE WHEN s9 IN (9, -9) THEN 1 ELSE 0 END AS r2, CASE WHEN m6 IN (6, -6) THEN 1 ELSE 0 END AS r3 FROM q) "
    f"SELECT time, eqp_id, log_id, {r('x', 4)} AS avg_pe, {r('mu', 4)} AS mu, {r('sigma', 4)} AS sigma, {r('mu + 3 * sigma', 4)} AS ucl, {r('mu - 3 * sigma', 4)} AS lcl, r1 AS rule1_beyond_3sigma, r2 AS rule2_nine_same_side, r3 AS rule3_six_trend, greatest(r1, r2, r3) AS any_rule_triggered FROM f"
)


@query("al8_nelson_rules", "tele", _NELSON)
def _(t):
    return control.nelson_rules(t.tele)


@query("al8_nelson_rules_split", same_as="al8_nelson_rules")
def _(t):
    return control.nelson_rules(t.tele, max_rows=TINY)


_ABS_JE0 = "greatest(" + ", ".join(f"abs(coalesce({c}, 0))" for c in JE_COLS) + ")"
_STAB = {"temp_score": "33 - coalesce(t.s, 99) * 10", "hum_score": "33 - coalesce(h.s, 99) * 10", "pe_score": "34 - coalesce(p.ps, 99) * 5 - coalesce(p.pm, 99) * 2", "je_score": "17 - coalesce(p.js, 99) * 5 - coalesce(p.jm, 99)"}


@query(
    "al9_process_stability", "tele",
    "WITH c AS (SELECT max(time) - INTERVAL 240 HOUR AS cut FROM tele), rc AS (SELECT * FROM tele WHERE time > (SELECT cut FROM c)), "
    "t AS (SELECT eqp_id, stddev_samp(temperature) AS s FROM rc WHERE temperature IS NOT NULL GROUP BY 1), h AS (SELECT eqp_id, stddev_samp(humidity) AS s FROM rc WHERE humidity IS NOT NULL GROUP BY 1), "
    f"p AS (SELECT eqp_id, avg({_ABS_PE0}) AS pm, stddev_samp({_ABS_PE0}) AS ps, avg({_ABS_JE0}) AS jm, stddev_samp({_ABS_JE0}) AS js FROM rc WHERE pe_1 IS NOT NULL GROUP BY 1) "
    "SELECT coalesce(t.eqp_id, h.eqp_id, p.eqp_id) AS eqp_id, " + ", ".join(f"{r(f'greatest(0, {e})', 1)} AS {n}" for n, e in _STAB.items())
    + ", " + r(" + ".join(f"greatest(0, {e})" for e in _STAB.values()), 1) + " AS stability_index FROM t FULL JOIN h ON t.eqp_id = h.eqp_id FULL JOIN p ON coalesce(t.eqp_id, h.eqp_id) = p.eqp_id",
)
def _(t):
    return spc.process_stability(t.tele, hours=240)


def _z_sql(measure: str, cur_filter: str = "") -> str:
    return (
        f"WITH s AS (SELECT device_id, avg({measure}) AS mu, stddev_samp({measure}) AS sigma FROM sysm WHERE time > {_A} - INTERVAL 30 DAY AND {measure} > 0 GROUP BY 1), "
        f"c AS (SELECT device_id, avg({measure}) AS v FROM sysm WHERE time > {_A} - INTERVAL 2 DAY {cur_filter} GROUP BY 1) "
        f"SELECT device_id, {r('abs(v - mu) / sigma', 4)} AS z FROM s JOIN c USING (device_id) WHERE sigma > 0 AND abs(v - mu) / sigma > 1"
    )


@query("al10_zscore_anomaly", "sysm", _z_sql("cpu_load_percent"))
def _(t):
    return infra.zscore_anomaly(t.sysm, "cpu_load_percent", AS_OF, "30 days", "2 days", 1.0)


@query("al10_zscore_temperature", "sysm", _z_sql("temp_c", "AND temp_c > 0"))
def _(t):
    return infra.zscore_anomaly(t.sysm, "temp_c", AS_OF, "30 days", "2 days", 1.0, cur_positive=True)


_CTX_COLS = ["temperature", "humidity", "air_vacuum", "scan_speed", "resist_dosage", "pe_1", "je_1", "process", "mo", "board_no", "total_board"]
_MEASURES = ["temperature", "humidity", "air_vacuum", "scan_speed", "resist_dosage", "pe_1", "je_1"]
# the alarm's own process and factory must not shadow the telemetry's
_CTX = "WITH " + cascade_sql(_CTX_COLS).replace("SELECT alarms.*,", "SELECT alarms.* EXCLUDE (process),") + (
    ", ctx AS (SELECT d.logdate AS alarm_time, d.equipmentid AS eqp_id, d.errorcode, m.alarm_msg, " + ", ".join(f"d.{c}" for c in _CTX_COLS) + ", "
    + ", ".join(f"{e} AS {n}" for n, e in FLAGS_SQL.items()) + ", d.match_type, m.severity, d.link_basis, d.logid AS alarm_id, d.related_log_id, m.alarm_detail FROM d LEFT JOIN catalog m ON d.errorcode = m.alarm_id)"
)


@query("al11_alarm_context", "alarms tele catalog", _CTX + " SELECT * REPLACE (" + ", ".join(f"{r(c, 4)} AS {c}" for c in _MEASURES) + ") FROM ctx")
def _(t):
    return rca.alarm_context(t.alarms, t.catalog, t.tele, back="5 hours").withColumns({c: fn.rnd(c, 4) for c in _MEASURES})


_RELATED = "CASE WHEN alarm_code = '91009' THEN 'air_vacuum' WHEN alarm_code = '90005' THEN 'pe_1..pe_6, je_1..je_4' WHEN alarm_code IN ('90001','90004','90012') THEN 'scale_x, scale_y, pe_1..pe_6' WHEN alarm_code = '91008' THEN 'temperature, humidity' WHEN alarm_code = '70004' THEN 'scan_speed' ELSE NULL END"


@query("al12_alarm_category", "catalog", f"SELECT alarm_code, {CATEGORY_SQL.format(c='alarm_code')} AS category, {_RELATED} AS related_columns FROM catalog")
def _(t):
    return rca.alarm_category(t.catalog)


def _flag_list(flag_of: str) -> str:
    """One struct per line of the report: its name, whether a row belongs to it, and whether its flag is up."""
    return "[" + ", ".join(flag_of.format(name=name, cats=", ".join(repr(c) for c in cats), flag=flag, tele=FLAGS_SQL[flag]) for name, cats, flag in rca.LIFT_LINES) + "]"


def _lift_sql(ctx_where: str, tele_where: str) -> str:
    seen = _flag_list("{{'line': '{name}', 'own': category IN ({cats}), 'up': coalesce({flag}, false)}}")
    usual = _flag_list("{{'line': '{name}', 'own': true, 'up': coalesce({tele}, false)}}")
    share = "100.0 * count(*) FILTER (u.own AND u.up) / NULLIF(count(*) FILTER (u.own), 0)"
    return (
        f"{_CTX}, marks AS (SELECT unnest({seen}) AS u FROM (SELECT ctx.*, {CATEGORY_SQL.format(c='errorcode')} AS category FROM ctx WHERE errorcode IN (SELECT alarm_code FROM catalog) AND {ctx_where})), "
        f"normal AS (SELECT unnest({usual}) AS u FROM tele WHERE {tele_where}), "
        f"report AS (SELECT line, coalesce(n, 0) AS n, pct, base FROM (SELECT unnest([{', '.join(repr(x[0]) for x in rca.LIFT_LINES)}]) AS line) LEFT JOIN (SELECT u.line AS line, count(*) FILTER (u.own) AS n, {share} AS pct FROM marks GROUP BY 1) USING (line) "
        f"LEFT JOIN (SELECT u.line AS line, {share} AS base FROM normal GROUP BY 1) USING (line)) "
        f"SELECT line AS alarm_category, {r('pct', 1)} AS alarm_window_pct, {r('base', 1)} AS baseline_pct, {r('pct / NULLIF(base, 0)', 2)} AS lift, n AS event_count, CASE WHEN n < 30 THEN 'LOW SAMPLE (n<30)' ELSE 'OK' END AS confidence FROM report"
    )


@query("al13_rca_lift_recent", "alarms tele catalog", _lift_sql(f"alarm_time > {_A} - INTERVAL 15 DAY", f"time > {_A} - INTERVAL 15 DAY"))
def _(t):
    ctx = rca.recent_context(t.alarms, t.catalog, t.tele, AS_OF, "15 days", back="5 hours")
    return rca.rca_lift(ctx, rca.alarm_category(t.catalog), t.tele, AS_OF, "15 days")


@query("al14_rca_truth_test", "alarms tele catalog", _lift_sql("true", "true"))
def _(t):
    ctx = rca.alarm_context(t.alarms, t.catalog, t.tele, back="5 hours")
    return rca.rca_lift(ctx, rca.alarm_category(t.catalog), t.tele, None, None)


@query(
    "al15_machine_snapshot", "tele alarms catalog",
    "WITH pairs AS (SELECT tele.log_id, alarms.logid, row_number() OVER (PARTITION BY tele.log_id ORDER BY abs(epoch_us(logdate) - epoch_us(tele.time)), logdate, alarms.logid) AS place "
    "FROM alarms JOIN tele ON eqp_id = equipmentid WHERE abs(epoch_us(logdate) - epoch_us(tele.time)) <= 7200000000) "
    "SELECT tele.time, eqp_id, tele.log_id, state, mo, board_id, errorcode AS alarm_errorcode, errortime AS alarm_errortime, alarms.logid AS alarm_logid, alarm_type, alarm_msg, alarm_detail "
    "FROM tele LEFT JOIN pairs ON pairs.log_id = tele.log_id AND place = 1 LEFT JOIN alarms ON alarms.logid = pairs.logid LEFT JOIN catalog ON alarm_code = errorcode",
)
def _(t):
    out = snapshot.machine_snapshot(t.tele, t.alarms, t.catalog, "2 hours")
    return out.select("time", "eqp_id", "log_id", "state", "mo", "board_id", "alarm_errorcode", "alarm_errortime", "alarm_logid", "alarm_type", "alarm_msg", "alarm_detail")


LATEST_SQL = (
    "lt AS (SELECT d.device_id AS eqp_id, d.hostname, d.location, t.* EXCLUDE (eqp_id), t.eqp_id IS NOT NULL AS has_data, (t.eqp_id IS NOT NULL AND t.time < " + _A + " - INTERVAL 2 DAY) AS is_stale FROM devices d "
    "LEFT JOIN (SELECT * FROM tele QUALIFY row_number() OVER (PARTITION BY eqp_id ORDER BY time DESC, log_id DESC) = 1) t ON t.eqp_id = d.device_id WHERE d.device_type = 'ldi' AND d.enabled)"
)


def latest(t: Tables) -> DataFrame:
    return snapshot.latest_full(t.devices, t.tele, AS_OF, stale="2 days")


def latest_stored(t: Tables) -> DataFrame:
    """The same from a table of newest rows, kept over three deliveries of which the newest comes before the oldest."""
    path = scratch_path(t.spark, "latest")
    us = F.unix_micros("time") % 3
    for part in (2, 0, 1):
        merge_latest(t.tele.where(us == part), path, ["eqp_id"], "time", "log_id")
    return snapshot.latest_full(t.devices, read_latest(t.spark, path, t.tele).drop("slot"), AS_OF, stale="2 days", stored=True)


@query("al16_latest_full", "devices tele", f"WITH {LATEST_SQL} SELECT eqp_id, hostname, location, time, log_id, state, mo, board_no, {r('temperature', 4)} AS temperature, has_data, is_stale FROM lt")
def _(t):
    return latest(t).select("eqp_id", "hostname", "location", "time", "log_id", "state", "mo", "board_no", fn.rnd("temperature", 4).alias("temperature"), "has_data", "is_stale")


@query("al16_latest_stored", same_as="al16_latest_full")
def _(t):
    return latest_stored(t).select("eqp_id", "hostname", "location", "time", "log_id", "state", "mo", "board_no", fn.rnd("temperature", 4).alias("temperature"), "has_data", "is_stale")


@query(
    "al17_event_timeline", "tele alarms catalog",
    f"WITH s AS (SELECT time, eqp_id, state, lag(state) OVER ({_W}) AS was FROM tele) SELECT time AS event_time, eqp_id, CASE WHEN state THEN 'Machine Start' ELSE 'Machine Stop' END AS event_type, 'telemetry' AS source, "
    "CASE WHEN state THEN 'state changed to RUNNING' ELSE 'state changed to DOWN' END AS description FROM s WHERE state <> was UNION ALL SELECT a.logdate, a.equipmentid, 'Alarm', 'alarm_log', coalesce(m.alarm_msg, a.errorcode) FROM alarms a LEFT JOIN catalog m ON m.alarm_code = a.errorcode",
)
def _(t):
    return snapshot.event_timeline(t.tele, t.alarms, t.catalog)


@query("al17_event_timeline_split", same_as="al17_event_timeline")
def _(t):
    return snapshot.event_timeline(t.tele, t.alarms, t.catalog, max_rows=16)


from .basics import _HEALTH  # noqa: E402

_FLEET_HEALTH = (
    f"fh AS (SELECT s.device_id AS machine_id, {r('cpu_load_percent', 1)} AS cpu_pct, {r('ram_used_mb / NULLIF(ram_total_mb, 0) * 100', 1)} AS ram_pct, {r('disk_used_gb / NULLIF(disk_total_gb, 0) * 100', 1)} AS disk_pct, {r('temp_c', 0)} AS temp_c, {r(_HEALTH, 1)} AS health_score, s.time "
    f"FROM sysm s JOIN devices d ON d.device_id = s.device_id WHERE s.time > {_A} - INTERVAL 10 DAY AND d.device_type = 'server' AND d.enabled QUALIFY row_number() OVER (PARTITION BY s.device_id ORDER BY s.time DESC) = 1)"
)


@query("al18_fleet_health", "sysm devices", f"WITH {_FLEET_HEALTH} SELECT * FROM fh")
def _(t):
    return infra.fleet_health(t.sysm, t.devices, AS_OF, "10 days")


@query("al18_fleet_score", "sysm devices", f"WITH {_FLEET_HEALTH} SELECT 'Fleet Score' AS metric, {r('avg(health_score)', 1)} AS value FROM fh")
def _(t):
    return infra.fleet_score(infra.fleet_health(t.sysm, t.devices, AS_OF, "10 days"))


_UP = (
    f"up AS (SELECT device_id AS machine_id, max(time) AS last_seen, {seconds(_A, 'max(time)')} AS s, avg(cpu_load_percent) AS c, avg(temp_c) AS t FROM sysm WHERE time > {_A} - INTERVAL 20 DAY GROUP BY 1), "
    f"us AS (SELECT machine_id, last_seen, CAST(round(CAST(s AS DECIMAL(38,6)), 0) AS INTEGER) AS seconds_since_last, CASE WHEN s <= 30 THEN 'online' WHEN s <= 300 THEN 'stale' ELSE 'offline' END AS health_status, {r('c', 2)} AS current_cpu, {r('t', 1)} AS current_temp FROM up)"
)


@query("al19_uptime_summary", "sysm", f"WITH {_UP} SELECT * FROM us")
def _(t):
    return infra.uptime_summary(t.sysm, AS_OF, "20 days")


@query("al19_fleet_uptime", "sysm", f"WITH {_UP} SELECT {r('100.0 * count(*) FILTER (WHERE health_status = ' + chr(39) + 'online' + chr(39) + ') / NULLIF(count(*), 0)', 2)} AS value FROM us")
def _(t):
    return infra.fleet_uptime(infra.uptime_summary(t.sysm, AS_OF, "20 days"))


def _forecast_sql(used: str, total: str, source: str) -> str:
    days = f"least((cap - cur) / NULLIF(slope, 0), 3650)"
    return (
        f"WITH h AS ({source}), d AS (SELECT device_id, date_trunc('day', bucket) AS day, avg({used}) AS used, avg({total}) AS total FROM h WHERE bucket > {_A} - INTERVAL 30 DAY AND {total} > 0 GROUP BY 1, 2), "
        "f AS (SELECT device_id, coalesce(regr_slope(used, epoch_us(day) / 86400000000.0), 0) AS slope, max(used) AS cur, max(total) AS cap, count(*) AS data_points FROM d GROUP BY 1 HAVING count(*) >= 7) "
        f"SELECT device_id, {r('cur', 2)} AS current_usage, {r('cap', 2)} AS total, {r('slope', 4)} AS daily_growth, CASE WHEN slope <= 0 THEN NULL WHEN cap <= cur THEN 0 ELSE {r(days, 0)} END AS days_until_full, "
        f"CASE WHEN slope <= 0 THEN NULL WHEN cap <= cur THEN {_A} ELSE date_trunc('day', make_timestamp(epoch_us({_A}) + CAST(floor({days} * 86400000000) AS BIGINT))) END AS projected_full_date, data_points FROM f"
    )


_HOURLY = "SELECT time_bucket(INTERVAL '1 hour', time) AS bucket, device_id, avg({u}) AS used_, avg({t}) AS total_ FROM sysm GROUP BY 1, 2"


def _month(t: Tables) -> DataFrame:
    """The readings of the buckets that a forecast looks at: a bucket begins before all its readings."""
    return fn.last(t.sysm, "time", "30 days", AS_OF)


@query("al20_disk_forecast", "sysm", _forecast_sql("used_", "total_", _HOURLY.format(u="disk_used_gb", t="disk_total_gb")))
def _(t):
    return infra.disk_forecast(rollup.infra_rollup(_month(t), "sys"), AS_OF)


@query("al58_resource_forecast", "sysm", _forecast_sql("used_", "total_", _HOURLY.format(u="ram_used_mb", t="ram_total_mb")))
def _(t):
    return infra.resource_forecast(rollup.infra_rollup(_month(t), "sys"), "avg_ram_used", "avg_ram_total", AS_OF)


_X = f"((epoch_us(time) - epoch_us({_A})) / 1000000.0)"


@query(
    "al21_saturation_forecast", "netm",
    f"SELECT device_id, {r('avg(rx_mbps)', 2)} AS value FROM netm WHERE time > {_A} - INTERVAL 30 DAY GROUP BY 1 HAVING avg(rx_mbps) > 700 AND count(*) >= 5 AND regr_slope(rx_mbps, {_X}) > 0 AND regr_slope(rx_mbps, {_X}) * 3600 + regr_intercept(rx_mbps, {_X}) > 800",
)
def _(t):
    return infra.saturation_forecast(t.netm, AS_OF, "30 days", mean=700.0, ceiling=800.0)


def _rule_sql(rule: str, src: str, metric: str, value: str, limit: float, severity: str, where: str = "true") -> str:
    return f"SELECT {metric} AS metric, '{rule}' AS rule, {r(value, 4)} AS value, '{severity}' AS severity FROM {src} WHERE time > {_A} - INTERVAL 3 DAY AND {where} GROUP BY 1 HAVING {value} > {limit}"


_SYS_RULE_SQL = " UNION ALL ".join([
    _rule_sql("cpu_high", "sysm", "device_id", "avg(cpu_load_percent)", 85, "warning"),
    _rule_sql("ram_high", "sysm", "device_id", "avg(ram_used_mb) / NULLIF(avg(ram_total_mb), 0) * 100", 90, "warning"),
    _rule_sql("disk_high", "sysm", "device_id", "avg(disk_used_gb) / NULLIF(avg(disk_total_gb), 0) * 100", 90, "critical"),
    _rule_sql("temp_high", "sysm", "device_id", "max(temp_c)", 80, "critical"),
])


@query("al22_threshold_sys", "sysm", _SYS_RULE_SQL)
def _(t):
    return infra.threshold_alerts(t.sysm, infra.SYS_RULES, AS_OF, window="3 days")


@query("al22_threshold_net", "netm devices", " UNION ALL ".join([
    _rule_sql("net_errors", "netm", "device_id || ' ' || iface_name", "CAST(sum(rx_errors) AS DOUBLE)", 100, "warning", "device_id IN (SELECT device_id FROM devices WHERE enabled)"),
    _rule_sql("net_drops", "netm", "device_id || ' ' || iface_name", "CAST(max(rx_drops) AS DOUBLE)", 50, "critical"),
]))
def _(t):
    return infra.threshold_alerts(t.netm, infra.NET_RULES, AS_OF, t.devices, window="3 days")


@query("al22_threshold_vibration", "machm", _rule_sql("vibration_critical", "machm", "device_id", "max(vibration)", 12, "critical"))
def _(t):
    return infra.threshold_alerts(t.machm, infra.MACHINE_RULES, AS_OF, window="3 days")


def _held_sql(rule: str, view: str, metric: str, agg: str, limit: float, severity: str, where: str = "true") -> str:
    """A rule on windows of twelve hours every three, firing once it has held for nine."""
    return (
        f"SELECT metric, '{rule}' AS rule, ts, {r('value', 4)} AS value, '{severity}' AS severity FROM (SELECT *, ts - max(since) OVER (PARTITION BY metric ORDER BY ts) AS held FROM ("
        "SELECT *, CASE WHEN cond AND NOT (coalesce(lag(cond) OVER w, false) AND ts - lag(ts) OVER w <= INTERVAL 3 HOUR) THEN ts END AS since FROM ("
        f"SELECT {metric} AS metric, time_bucket(INTERVAL 3 HOUR, time) + i * INTERVAL 3 HOUR AS ts, {agg} AS value, coalesce({agg} > {limit}, false) AS cond FROM {view}, generate_series(1, 4) g(i) WHERE {where} GROUP BY 1, 2) "
        "WINDOW w AS (PARTITION BY metric ORDER BY ts))) WHERE cond AND held >= INTERVAL 9 HOUR"
    )


@query("al22_sys_sustained", "sysm", " UNION ALL ".join([
    _held_sql("cpu_high", "sysm", "device_id", "avg(cpu_load_percent)", 85, "warning"),
    _held_sql("ram_high", "sysm", "device_id", "avg(ram_used_mb) / nullif(avg(ram_total_mb), 0) * 100", 90, "warning"),
    _held_sql("disk_high", "sysm", "device_id", "avg(disk_used_gb) / nullif(avg(disk_total_gb), 0) * 100", 90, "critical"),
    _held_sql("temp_high", "sysm", "device_id", "max(temp_c)", 80, "critical"),
]))
def _(t):
    return infra.sustained_alerts(t.sysm, infra.SYS_RULES, step="3 hours", window="12 hours", hold="9 hours")


@query("al22_net_sustained", "netm devices", " UNION ALL ".join([
    _held_sql("net_errors", "netm", "device_id || ' ' || iface_name", "CAST(sum(rx_errors) AS DOUBLE)", 100, "warning", "device_id IN (SELECT device_id FROM devices WHERE enabled)"),
    _held_sql("net_drops", "netm", "device_id || ' ' || iface_name", "CAST(max(rx_drops) AS DOUBLE)", 50, "critical"),
]))
def _(t):
    return infra.sustained_alerts(t.netm, infra.NET_RULES, t.devices, step="3 hours", window="12 hours", hold="9 hours")


@query("al23_interface_down", "netm", f"SELECT device_id, iface_name, count(*) AS value FROM netm WHERE time > {_A} - INTERVAL 5 DAY GROUP BY 1, 2 HAVING count(*) FILTER (WHERE status = 'DOWN') > count(*) FILTER (WHERE status = 'UP')")
def _(t):
    return infra.interface_down(t.netm, AS_OF, "5 days")


@query(
    "al27_probe_sla", "probes",
    f"WITH s AS (SELECT instance, max_by(struct_pack(success := success, d := duration_s, c := cert_expiry), (time, probe_id)) AS now, avg(success) AS up FROM probes WHERE time > {_A} - INTERVAL 10 DAY GROUP BY 1), "
    f"x AS (SELECT instance, now, (1 - up) * 100 AS err, {seconds('now.c', _A)} / 86400 AS days FROM s) "
    f"SELECT instance, 'ServiceDown' AS alertname, {r('now.success', 4)} AS value FROM x WHERE now.success = 0 UNION ALL SELECT instance, 'ServiceHighLatency', {r('now.d', 4)} FROM x WHERE now.d > 2 "
    f"UNION ALL SELECT instance, 'SLABreachWarning', {r('err', 4)} FROM x WHERE err > 0.01 UNION ALL SELECT instance, 'SSLCertExpiring', {r('days', 4)} FROM x WHERE days < 30",
)
def _(t):
    return infra.probe_sla(t.probes, AS_OF, "10 days")


# ------------------------------------------------------------------------------------------ rollups

_SYS_H = "sh AS (SELECT time_bucket(INTERVAL '1 hour', time) AS bucket, device_id, count(*) AS sample_count, avg(cpu_load_percent) AS avg_cpu, max(cpu_load_percent) AS max_cpu, avg(ram_used_mb) AS avg_ram_used, max(temp_c) AS max_temp FROM sysm GROUP BY 1, 2)"
_UP_TIER = "SELECT time_bucket(INTERVAL '{w}', bucket) AS bucket, device_id, CAST(sum(sample_count) AS BIGINT) AS sample_count, avg(avg_cpu) AS avg_cpu, max(max_cpu) AS max_cpu, avg(avg_ram_used) AS avg_ram_used, max(max_temp) AS max_temp FROM {src} GROUP BY 1, 2"
_SYS_OUT = f"bucket, device_id, sample_count, {r('avg_cpu', 4)} AS avg_cpu, {r('max_cpu', 4)} AS max_cpu, {r('avg_ram_used', 4)} AS avg_ram_used, {r('max_temp', 4)} AS max_temp"


def _sys_out(df: DataFrame) -> DataFrame:
    return df.select("bucket", "device_id", "sample_count", *[fn.rnd(c, 4).alias(c) for c in ("avg_cpu", "max_cpu", "avg_ram_used", "max_temp")])


@query("al28_infra_hourly", "sysm", f"WITH {_SYS_H} SELECT {_SYS_OUT} FROM sh")
def _(t):
    return _sys_out(rollup.infra_rollup(t.sysm, "sys"))


@query("al28_infra_daily", "sysm", f"WITH {_SYS_H}, sd AS ({_UP_TIER.format(w='1 day', src='sh')}) SELECT {_SYS_OUT} FROM sd")
def _(t):
    return _sys_out(rollup.infra_rollup(t.sysm, "sys", "day"))


@query("al28_infra_weekly", "sysm", f"WITH {_SYS_H}, sd AS ({_UP_TIER.format(w='1 day', src='sh')}), sw AS ({_UP_TIER.format(w='7 days', src='sd')}) SELECT {_SYS_OUT} FROM sw")
def _(t):
    return _sys_out(rollup.infra_rollup(t.sysm, "sys", "week"))


@query("al28_net_hourly", "netm", f"SELECT time_bucket(INTERVAL '1 hour', time) AS bucket, device_id, iface_name, count(*) AS sample_count, {r('avg(rx_mbps)', 4)} AS avg_rx, max(rx_mbps) AS max_rx, {r('avg(tx_mbps)', 4)} AS avg_tx, max(tx_mbps) AS max_tx, CAST(sum(rx_errors) AS BIGINT) AS total_errors, CAST(sum(rx_drops) AS BIGINT) AS total_drops FROM netm GROUP BY 1, 2, 3")
def _(t):
    return rollup.infra_rollup(t.netm, "net").withColumns({c: fn.rnd(c, 4) for c in ("avg_rx", "avg_tx")})


@query("al28_machine_hourly", "machm", "SELECT time_bucket(INTERVAL '1 hour', time) AS bucket, device_id, count(*) AS sample_count, " + ", ".join(f"{r(f'{f}({c})', 4)} AS {n}" for n, (f, c) in rollup.INFRA_SPECS["ldi"][1].items()) + " FROM machm GROUP BY 1, 2")
def _(t):
    return rollup.infra_rollup(t.machm, "ldi").withColumns({c: fn.rnd(c, 4) for c in rollup.INFRA_SPECS["ldi"][1]})


_TK = ", ".join(rollup.TELEMETRY_KEYS)
_M1 = f"m1 AS (SELECT time_bucket(INTERVAL '1 minute', time) AS bucket, {_TK}, count(*) AS sample_count, " + ", ".join(f"avg({m}) AS avg_{m}" for m in rollup.TELEMETRY_MEASURES) + f" FROM tele GROUP BY 1, {_TK})"


def _tier(width: str, src: str) -> str:
    return f"(SELECT time_bucket(INTERVAL '{width}', bucket) AS bucket, {_TK}, CAST(sum(sample_count) AS BIGINT) AS sample_count, " + ", ".join(f"avg(avg_{m}) AS avg_{m}" for m in rollup.TELEMETRY_MEASURES) + f" FROM {src} GROUP BY ALL)"


_TOUT = f"bucket, {_TK}, sample_count, " + ", ".join(f"{r(f'avg_{m}', 4)} AS avg_{m}" for m in rollup.TELEMETRY_MEASURES)


def _tele_out(df: DataFrame) -> DataFrame:
    return df.withColumns({c: fn.rnd(c, 4) for c in df.columns if c.startswith("avg_")})


@query("al29_telemetry_1m", "tele", f"WITH {_M1} SELECT {_TOUT} FROM m1")
def _(t):
    return _tele_out(rollup.telemetry_rollup(t.tele, "1m"))


@query("al29_telemetry_15m", "tele", f"WITH {_M1} SELECT {_TOUT} FROM {_tier('15 minutes', 'm1')}")
def _(t):
    return _tele_out(rollup.telemetry_rollup(t.tele, "15m", "avg_of_avg"))


@query("al29_telemetry_1h", "tele", f"WITH {_M1}, m15 AS {_tier('15 minutes', 'm1')} SELECT {_TOUT} FROM {_tier('1 hour', 'm15')}")
def _(t):
    return _tele_out(rollup.telemetry_rollup(t.tele, "1h", "avg_of_avg"))


@query("ag11_reaggregate_weighted", "tele", f"SELECT time_bucket(INTERVAL '1 hour', time) AS bucket, {_TK}, count(*) AS sample_count, " + ", ".join(f"{r(f'avg({m})', 4)} AS avg_{m}" for m in rollup.TELEMETRY_MEASURES) + f" FROM tele GROUP BY 1, {_TK}")
def _(t):
    return _tele_out(rollup.telemetry_rollup(t.tele, "1h", "weighted"))


@query(
    "al30_direct_hourly", "tele",
    f"SELECT time_bucket(INTERVAL '1 hour', time) AS bucket, eqp_id, {r('avg(temperature)', 4)} AS avg_temp, {r('max(temperature)', 4)} AS max_temp, {r('avg(humidity)', 4)} AS avg_humidity, {r(f'avg({_ABS_PE})', 4)} AS avg_max_pe, {r(f'max({_ABS_PE})', 4)} AS peak_pe, "
    f"{r('avg(scan_speed)', 4)} AS avg_scan_speed, {r('avg(air_vacuum)', 4)} AS avg_air_vacuum, count(*) AS sample_count FROM tele GROUP BY 1, 2",
)
def _(t):
    out = rollup.direct_hourly(t.tele)
    return out.withColumns({c: fn.rnd(c, 4) for c in out.columns if c not in ("bucket", "eqp_id", "sample_count")})


_HR = {"avg_temperature": ("avg(temperature)", 2), "avg_humidity": ("avg(humidity)", 2), "avg_scan_speed": ("avg(scan_speed)", 1), "avg_resist_dosage": ("avg(resist_dosage)", 1), "avg_air_vacuum": ("avg(air_vacuum)", 2), "avg_thickness": ("avg(thickness)", 3),
       "max_temperature": ("max(temperature)", 2), "min_temperature": ("min(temperature)", 2), "max_humidity": ("max(humidity)", 2), "min_humidity": ("min(humidity)", 2), "avg_pe": ("avg(list_avg([" + ", ".join(PE_COLS) + "]))", 3), "max_abs_pe": (f"max({_ABS_PE0})", 2), "avg_cycle_time": ("avg(total_time / NULLIF(total_board, 0))", 2)}


@query("al31_engineering_hourly", "tele", "SELECT time_bucket(INTERVAL '1 hour', time) AS bucket, eqp_id, " + ", ".join(f"{r(e, d)} AS {n}" for n, (e, d) in _HR.items()) + ", count(DISTINCT eqp_id) AS machine_count FROM tele WHERE pe_1 IS NOT NULL GROUP BY 1, 2")
def _(t):
    return rollup.engineering_hourly(t.tele)


_OEE = f"SELECT time_bucket(INTERVAL '{{w}}', time) AS bucket, eqp_id, factory, count(*) AS sample_count, count(*) FILTER (WHERE state) AS running_count, count(*) FILTER (WHERE {_ABS_PE0} <= pe_setting) AS in_spec_count, count(DISTINCT board_no) AS board_count FROM tele GROUP BY 1, 2, 3"


@query("al32_oee_partials", "tele", _OEE.format(w="1 minute"))
def _(t):
    return rollup.oee_partials(t.tele)


@query(
    "al32_oee", "tele devices",
    f"WITH p AS ({_OEE.format(w='1 hour')}), m AS (SELECT eqp_id, sum(sample_count) AS n, sum(running_count) AS up, sum(in_spec_count) AS good, sum(board_count) AS boards, count(*) * 60.0 AS minutes FROM p GROUP BY 1), "
    "c AS (SELECT device_id, 28.5 AS ic, 220.0 AS dc, 140.0 AS sc FROM devices WHERE enabled), "
    "x AS (SELECT eqp_id, CAST(up AS DOUBLE) / n AS a, CAST(good AS DOUBLE) / n AS q, boards, minutes, coalesce(ic, 30.0) AS ic, coalesce(dc, 250.0) AS dc, coalesce(sc, 150.0) AS sc FROM m LEFT JOIN c ON c.device_id = m.eqp_id), "
    "y AS (SELECT *, CASE WHEN minutes * a * 60 = 0 THEN 1.0 ELSE least(1.0, CAST(boards AS DOUBLE) * ic / (minutes * a * 60)) END AS p FROM x) "
    f"SELECT eqp_id, {r('a', 4)} AS availability, {r('p', 4)} AS performance, {r('q', 4)} AS quality, {r('a * p * q', 4)} AS oee, {r('minutes * (1 - a) * dc + boards * (1 - q) * sc', 2)} AS copq FROM y",
)
def _(t):
    config = t.devices.where("enabled").select(F.col("device_id").alias("eqp_id"), F.lit(28.5).alias("ideal_cycle_sec"), F.lit(220.0).alias("downtime_cost_per_min"), F.lit(140.0).alias("scrap_cost_per_board"))
    return rollup.oee(rollup.oee_partials(t.tele, "1 hour"), config, 60.0)


@query("al32_boards_hourly", "tele", "SELECT time_bucket(INTERVAL '1 hour', time) AS bucket, eqp_id, factory, count(DISTINCT board_no) AS board_count FROM tele GROUP BY 1, 2, 3 HAVING count(board_no) > 0")
def _(t):
    path = scratch_path(t.spark, "boards")
    rollup.board_bitmaps(t.tele).write.parquet(path)
    return rollup.distinct_boards(rollup.wider_bitmaps(t.spark.read.parquet(path), "1 hour"))


@query(
    "al33_legacy_oee", "legacy",
    f"WITH l AS (SELECT * FROM legacy WHERE time > {_A} - INTERVAL 10 DAY QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY time DESC, row_id DESC) = 1), "
    f"d AS (SELECT machine_id, avg(pe) AS p, avg(je) AS j, avg(throughput) AS t, avg(uptime) AS u FROM legacy WHERE time > {_A} - INTERVAL 30 DAY GROUP BY 1) "
    f"SELECT l.machine_id, CASE WHEN uptime > 0 THEN {r('throughput / NULLIF(uptime, 0) * (1 - (pe + je) / 200) * 100', 1)} ELSE 0 END AS oee, CASE WHEN uptime > 0 THEN {r('uptime / 86400 * 100', 1)} ELSE 100 END AS availability, "
    f"CASE WHEN uptime > 0 THEN {r('throughput / NULLIF(uptime, 0) * 100', 1)} ELSE 0 END AS performance, CASE WHEN pe + je > 0 THEN {r('100 - (pe + je) / 2', 1)} ELSE 100 END AS quality, CASE WHEN u > 0 THEN {r('(p + j) / 200 * t * 86400 * 250', 0)} ELSE 0 END AS daily_loss FROM l JOIN d USING (machine_id)",
)
def _(t):
    return rollup.legacy_oee(t.legacy, AS_OF, "10 days", "30 days")


def _tier_sql(lo: str, hi: str, src: str) -> str:
    return f"SELECT {_TOUT} FROM {src} WHERE bucket BETWEEN TIMESTAMP '{lo}' AND TIMESTAMP '{hi}'"


def _tiered(t: Tables, lo: str, hi: str, watermark: str) -> DataFrame:
    """The tier of the range is stored up to the watermark; what is newer comes live."""
    builds = {g: partial(rollup.telemetry_rollup, grain=g, mode="avg_of_avg") for g in ("1m", "15m", "1h")}
    root, tier = scratch_path(t.spark, "tiers"), rollup.tier_for(lo, hi)
    maintenance.refresh_rollup(t.tele, f"{root}/{tier}", builds[tier], "time", "1 hour", watermark, "400 days", "0 seconds")
    return maintenance.read_stored_tier(t.spark, root, t.tele, builds, "time", lo, hi, watermark)


@query("al34_tiered_read_day", "tele", f"WITH {_M1} " + _tier_sql("2024-01-10 00:00:00", "2024-01-11 12:00:00", _tier("15 minutes", "m1")))
def _(t):
    return _tele_out(_tiered(t, "2024-01-10", "2024-01-11 12:00:00", "2024-01-11 00:00:00"))


@query("al34_tiered_read_month", "tele", f"WITH {_M1}, m15 AS {_tier('15 minutes', 'm1')} " + _tier_sql("2024-01-01 00:00:00", "2024-01-31 00:00:00", _tier("1 hour", "m15")))
def _(t):
    return _tele_out(_tiered(t, "2024-01-01", "2024-01-31", "2024-01-20 00:00:00"))


# ------------------------------------------------------------------------------------------ reports on context and charts

@query("al44_flag_matrix", "alarms tele catalog", _CTX + f" SELECT errorcode, count(*) AS n, {r('100.0 * count(*) FILTER (WHERE flag_pe_out_of_spec) / count(*)', 1)} AS pct_pe_oos, {r('100.0 * count(*) FILTER (WHERE flag_vac_out_of_spec) / count(*)', 1)} AS pct_vac_oos, {r('100.0 * count(*) FILTER (WHERE flag_temp_out_of_spec) / count(*)', 1)} AS pct_env_oos FROM ctx GROUP BY 1")
def _(t):
    return rca.flag_matrix(rca.alarm_context(t.alarms, t.catalog, t.tele, back="5 hours"))


@query("al45_out_of_spec_rates", "tele", "SELECT " + ", ".join(f"{r(f'100.0 * count(*) FILTER (WHERE {FLAGS_SQL[f]}) / count(*)', 2)} AS {n}" for n, f in (("pct_vac_oos", "flag_vac_out_of_spec"), ("pct_env_oos", "flag_temp_out_of_spec"), ("pct_pe_oos", "flag_pe_out_of_spec"))) + " FROM tele")
def _(t):
    return rca.out_of_spec_rates(t.tele)


@query(
    "al49_state_grid", "tele devices",
    "WITH g AS (SELECT d.device_id AS eqp_id, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS bucket FROM devices d WHERE d.device_type = 'ldi' AND d.enabled), "
    "s AS (SELECT eqp_id, time_bucket(INTERVAL '1 hour', time) AS bucket, arg_max(state, (time, log_id)) AS st FROM tele GROUP BY 1, 2) "
    "SELECT g.bucket, g.eqp_id, CASE WHEN s.st IS NULL THEN 'NO_DATA' WHEN s.st THEN 'RUNNING' ELSE 'IDLE' END AS state FROM g LEFT JOIN s ON s.eqp_id = g.eqp_id AND s.bucket = g.bucket",
)
def _(t):
    return snapshot.state_grid(t.tele, t.devices, "2024-01-01", AS_OF, "1 hour")


@query(
    "al50_dynamic_limits", "tele",
    f"WITH s AS (SELECT time, eqp_id, log_id, thickness AS x FROM tele), m AS (SELECT *, avg(x) OVER v AS mu, stddev_samp(x) OVER v AS sg, sum(x - 1.05 - 0.01) OVER w AS su, sum(1.05 - x - 0.01) OVER w AS sd FROM s WINDOW v AS ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), w AS ({_W} ROWS UNBOUNDED PRECEDING)), "
    f"c AS (SELECT *, su - least(0, min(su) OVER w) AS cp, sd - least(0, min(sd) OVER w) AS cn FROM m WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)) "
    f"SELECT time, eqp_id, log_id, {r('x', 4)} AS x, {r('mu', 4)} AS centre, {r('mu + 3 * sg', 4)} AS ucl, {r('mu - 3 * sg', 4)} AS lcl, CASE WHEN {r('cp', 3)} > 0.1 OR {r('cn', 3)} > 0.1 THEN 1 ELSE 0 END AS shift_flag FROM c",
)
def _(t):
    return control.dynamic_limits(t.tele, "thickness", 30, target=1.05, k=0.01, h=0.1)


@query("al51_cycle_time_grid", "tele", f"SELECT eqp_id, time_bucket(INTERVAL '5 minutes', time) AS bucket, {r('avg(total_time)', 3)} AS avg_total_time, count(*) AS n FROM tele GROUP BY 1, 2")
def _(t):
    return snapshot.cycle_time_grid(t.tele)


@query("al51_fleet_cycle_time", "tele", f"SELECT {r('avg(total_time / NULLIF(total_board, 0))', 4)} AS avg_cycle_time, count(*) AS n FROM tele")
def _(t):
    return snapshot.fleet_cycle_time(t.tele)


_IMPACT = "CASE WHEN {pe} THEN 'PE/JE Out of Spec' WHEN {th} THEN 'Thermal Out of Spec' WHEN {hu} THEN 'Humidity Out of Spec' WHEN {va} THEN 'Vacuum Out of Spec' WHEN {sc} THEN 'Scan Speed Out of Spec' WHEN {ex} THEN 'Exposure Out of Spec' ELSE 'Within Spec' END".format(
    pe=FLAGS_SQL["flag_pe_out_of_spec"], th=FLAGS_SQL["flag_thermal_out_of_spec"], hu=FLAGS_SQL["flag_humidity_out_of_spec"], va=FLAGS_SQL["flag_vac_out_of_spec"], sc=FLAGS_SQL["flag_scan_speed_out_of_spec"], ex=FLAGS_SQL["flag_exposure_out_of_spec"]
)


@query("al52_board_trace", "tele", f"SELECT time, eqp_id, mo, fpn, layer_name, board_no, total_board, board_id, log_id, {_IMPACT} AS quality_impact FROM tele ORDER BY time DESC, log_id DESC LIMIT 200")
def _(t):
    return rca.board_trace(t.tele)


@query("al52_quality_impact", "alarms tele catalog", _CTX + f" SELECT alarm_id, {_IMPACT} AS quality_impact FROM ctx")
def _(t):
    return rca.with_quality_impact(rca.alarm_context(t.alarms, t.catalog, t.tele, back="5 hours")).select("alarm_id", "quality_impact")


_XBAR = "list_avg([" + ", ".join(PE_COLS) + "])"
_RNG = "(greatest(" + ", ".join(PE_COLS) + ") - least(" + ", ".join(PE_COLS) + "))"


@query(
    "al54_xbar_r", "tele",
    f"WITH s AS (SELECT time, eqp_id, log_id, {_XBAR} AS x, {_RNG} AS rg FROM tele WHERE pe_1 IS NOT NULL), c AS (SELECT eqp_id, avg(x) AS xx, avg(rg) AS rr FROM s GROUP BY 1) "
    f"SELECT time, eqp_id, log_id, {r('x', 4)} AS xbar, {r('rg', 4)} AS r, {r('xx + 0.483 * rr', 4)} AS x_ucl, {r('xx - 0.483 * rr', 4)} AS x_lcl, {r('2.004 * rr', 4)} AS r_ucl, {r('0 * rr', 4)} AS r_lcl FROM s JOIN c USING (eqp_id)",
)
def _(t):
    return spc.xbar_r(t.tele)


@query(
    "al55_error_distribution", "tele",
    f"WITH u AS ({UNPIVOT_PE.format(keep='eqp_id')}) SELECT eqp_id, count(*) AS n, {r('min(sample)', 4)} AS lo, {r('quantile_cont(sample, 0.25)', 4)} AS q1, {r('quantile_cont(sample, 0.5)', 4)} AS med, {r('quantile_cont(sample, 0.75)', 4)} AS q3, {r('max(sample)', 4)} AS hi, {r('stddev_samp(sample)', 4)} AS sigma FROM u WHERE sample IS NOT NULL GROUP BY 1",
)
def _(t):
    return spc.error_distribution(t.tele)


@query("al57_top_nodes", "sysm devices", f"WITH {_FLEET_HEALTH} SELECT machine_id, health_score FROM fh ORDER BY health_score NULLS LAST, machine_id LIMIT 10")
def _(t):
    return infra.top_nodes(infra.fleet_health(t.sysm, t.devices, AS_OF, "10 days"))


@query("al60_env_compliance", "devices tele", f"WITH {LATEST_SQL}, k AS (SELECT count(*) FILTER (WHERE temperature IS NOT NULL AND humidity IS NOT NULL) AS reporting, count(*) FILTER (WHERE temperature IS NOT NULL AND humidity IS NOT NULL AND NOT {FLAGS_SQL['flag_temp_out_of_spec']}) AS in_spec FROM lt) SELECT reporting, in_spec, {r('100.0 * in_spec / NULLIF(reporting, 0)', 1)} AS compliance_pct FROM k")
def _(t):
    return snapshot.env_compliance(latest(t))


@query("al60_env_stored", same_as="al60_env_compliance")
def _(t):
    return snapshot.env_compliance(latest_stored(t))


@query("al60_env_timeline", "tele", f"SELECT eqp_id, time_bucket(INTERVAL '1 hour', time) AS bucket, count(*) AS n, {r('100.0 * count(*) FILTER (WHERE NOT ' + FLAGS_SQL['flag_temp_out_of_spec'] + ') / count(*)', 1)} AS in_spec_pct FROM tele GROUP BY 1, 2")
def _(t):
    return snapshot.env_timeline(t.tele)


@query(
    "al61_around_event", "tele alarms",
    "WITH p AS (SELECT eqp_id AS e, time AS at FROM tele WHERE log_id = (SELECT max(log_id) FROM tele)), ev AS (SELECT time AS event_time, eqp_id, 'telemetry' AS source, log_id AS ref FROM tele UNION ALL SELECT logdate, equipmentid, 'alarm', logid FROM alarms) "
    "SELECT ev.* FROM ev JOIN p ON ev.eqp_id = p.e AND ev.event_time BETWEEN p.at - INTERVAL 3 DAY AND p.at + INTERVAL 3 DAY",
)
def _(t):
    selected = t.tele.agg(F.max("log_id")).first()[0]
    return snapshot.around_event(t.tele, t.alarms, selected, "3 days")


