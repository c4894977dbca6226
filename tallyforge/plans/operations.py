"""Alarm operations, alert handling and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import alarms as al
from ..operators import infra, quality, rca, snapshot, spc
from ..operators.cycles import poll_cycles
from ..operators.notify import notifications
from ..schema import JE_COLS, PE_COLS
from .analytics import _KEYS, LATEST_SQL, _ranking_sql, latest, latest_stored
from .basics import _ABS_JE, _ABS_PE, FLAGS_SQL
from .registry import query, r, seconds
from .tables import AS_OF, CATEGORY_SQL, Tables, view_sql

_A = f"TIMESTAMP '{AS_OF}'"

# ------------------------------------------------------------------------------------------ alert rules on telemetry


@query(
    "al24_quality_drift", "tele",
    f"WITH b AS (SELECT time_bucket(INTERVAL '5 minutes', time) AS bucket, eqp_id, max({_ABS_PE}) AS v, max(pe_setting) AS s FROM tele WHERE time >= {_A} - INTERVAL 30 DAY AND pe_1 IS NOT NULL AND coalesce(pe_setting, 0) > 2 GROUP BY 1, 2) SELECT bucket, eqp_id, {r('v', 4)} AS value FROM b WHERE v > s",
)
def _(t: Tables) -> DataFrame:
    return al.quality_drift(t.tele, AS_OF, PE_COLS, "pe_setting", "30 days")


@query(
    "al24_quality_drift_je", "tele",
    f"WITH b AS (SELECT time_bucket(INTERVAL '5 minutes', time) AS bucket, eqp_id, max({_ABS_JE}) AS v, max(je_setting) AS s FROM tele WHERE time >= {_A} - INTERVAL 30 DAY AND je_1 IS NOT NULL AND coalesce(je_setting, 0) > 2 GROUP BY 1, 2) SELECT bucket, eqp_id, {r('v', 4)} AS value FROM b WHERE v > s",
)
def _(t):
    return al.quality_drift(t.tele, AS_OF, JE_COLS, "je_setting", "30 days")


@query(
    "al25_capability_alert", "tele",
    _ranking_sql("true") + f" SELECT {_KEYS}, 'PE' AS surface, cpk AS value, sample_count AS n FROM rk WHERE cpk < 1.33 AND sample_count >= 20 UNION ALL SELECT {_KEYS}, 'JE', cpk_je, sample_count_je FROM rk WHERE cpk_je < 1.33 AND sample_count_je >= 20",
)
def _(t):
    return spc.capability_alert(spc.spc_ranking(t.tele, hours=None), n=20)


@query("al26_new_alarms", "alarms", f"SELECT logdate, equipmentid AS eqp_id, 1 AS value FROM alarms WHERE logdate >= {_A} - INTERVAL 2 DAY")
def _(t):
    return al.new_alarms(t.alarms, AS_OF, "2 days")


@query("al26_temp_high", "tele", f"SELECT time_bucket(INTERVAL '5 minutes', time) AS bucket, eqp_id, {r('avg(temperature)', 4)} AS value FROM tele WHERE time >= {_A} - INTERVAL 30 DAY AND temperature > 24 GROUP BY 1, 2 HAVING avg(temperature) > 24")
def _(t):
    return al.temp_high(t.tele, AS_OF, "30 days")


# ------------------------------------------------------------------------------------------ alarm desk

@query("al35_classify_severity", "catalog", "SELECT alarm_id, alarm_msg, alarm_type, alarm_detail, severity FROM catalog")
def _(t):
    return t.catalog.select("alarm_id", "alarm_msg", "alarm_type", "alarm_detail", "severity")


_OWNER = (
    "CASE {c} WHEN 'VACUUM' THEN 'Maintenance' WHEN 'MOTION' THEN 'Maintenance' WHEN 'ENVIRONMENT' THEN 'Facility' WHEN 'COMMUNICATION' THEN 'Automation' WHEN 'ALIGNMENT' THEN 'Process Engineering' "
    "WHEN 'CALIBRATION' THEN 'Process Engineering' WHEN 'REGISTRATION' THEN 'Process Engineering' ELSE 'Maintenance' END"
)
_ACTION = "CASE {c} WHEN 'Maintenance' THEN 'CALL MAINT' WHEN 'Facility' THEN 'CHECK HVAC' WHEN 'Automation' THEN 'CHECK AUTOMATION' WHEN 'IT' THEN 'CALL IT' WHEN 'Process Engineering' THEN 'CHECK PROCESS' END"
_S = seconds(_A, "a.logdate")
_ELAPSED = (
    f"CASE WHEN {_S} < 3600 THEN CAST(CAST(floor({_S} / 60) AS BIGINT) AS VARCHAR) || 'm' ELSE CAST(CAST(floor({_S} / 3600) AS BIGINT) % 24 AS VARCHAR) || 'h' || lpad(CAST(CAST(floor({_S} / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') || 'm' END"
)


def _queue_sql(where: str) -> str:
    """Open serious alarms, what is known of each, then the labels; one line that says so when there are none."""
    codes = "SELECT alarm_code AS errorcode, severity, alarm_type, alarm_msg, alarm_detail FROM catalog WHERE severity = 'Critical' OR severity = 'Major'"
    return (
        f"WITH serious AS ({codes}), open AS (SELECT a.logid, a.logdate, a.equipmentid, a.errorcode, a.factory, a.related_log_id, {_ELAPSED} AS elapsed FROM alarms a WHERE {where} AND errorcode IN (SELECT errorcode FROM serious)), "
        "stage AS (SELECT logid, logdate, max(status) AS status FROM lifecycle GROUP BY ALL), "
        "made AS (SELECT open.logid, any_value(tele.factory) AS made_in, any_value(tele.mo) AS mo FROM tele JOIN open ON tele.log_id = related_log_id WHERE abs(epoch_us(tele.time) - epoch_us(logdate)) <= 600000000 GROUP BY ALL), "
        f"labelled AS (SELECT logid, related_log_id, logdate, equipmentid AS machine, severity, status, alarm_type, alarm_msg, alarm_detail, coalesce(made_in, factory) AS factory, mo, logdate AS \"when\", epoch_us(logdate) // 1000 AS when_ms, elapsed, "
        f"{_OWNER.format(c='(' + CATEGORY_SQL.format(c='errorcode') + ')')} AS owner FROM open JOIN serious USING (errorcode) LEFT JOIN stage USING (logid, logdate) LEFT JOIN made USING (logid) WHERE coalesce(status, '') <> 'RESOLVED'), "
        f"none AS (SELECT CASE WHEN EXISTS (FROM labelled) THEN 0 ELSE 1 END AS n) SELECT *, {_ACTION.format(c='owner')} AS action FROM labelled "
        f"UNION ALL BY NAME SELECT 'NONE' AS severity, 'NONE' AS status, 'NO ACTIVE CRITICAL/MAJOR ALARMS' AS alarm_msg, {_A} AS \"when\", 0 AS when_ms FROM none WHERE n = 1"
    )


def _queue(t: Tables, window: str, **kw) -> DataFrame:
    return al.action_queue(t.alarms, t.catalog, t.tele, t.lifecycle, rca.alarm_category(t.catalog), AS_OF, window, **kw)


@query("al36_action_queue", "alarms catalog tele lifecycle", _queue_sql(f"a.logdate > {_A} - INTERVAL 30 DAY"))
def _(t):
    return _queue(t, "30 days", k=None)


@query("al36_action_queue_top", "alarms catalog tele lifecycle", _queue_sql(f"a.logdate > {_A} - INTERVAL 30 DAY") + " ORDER BY CASE severity WHEN 'Critical' THEN 0 WHEN 'Major' THEN 1 WHEN 'NONE' THEN 2 ELSE 3 END, \"when\" DESC, logid LIMIT 50")
def _(t):
    return _queue(t, "30 days", k=50)


@query("al36_action_queue_empty", "alarms catalog tele lifecycle", _queue_sql("a.equipmentid IN ('nobody')"))
def _(t):
    return _queue(t, "30 days", machines=["nobody"])


@query(
    "al37_machine_state", "devices tele alarms catalog lifecycle",
    f"WITH {LATEST_SQL}, ar AS (SELECT a.equipmentid, a.logid, a.logdate, a.related_log_id, l.status, CASE m.severity WHEN 'Critical' THEN 0 ELSE 1 END AS rk, {_OWNER.format(c=CATEGORY_SQL.format(c='a.errorcode'))} AS owner, {_ELAPSED} AS elapsed "
    f"FROM alarms a JOIN catalog m ON m.alarm_code = a.errorcode LEFT JOIN lifecycle l ON l.logdate = a.logdate AND l.logid = a.logid WHERE m.severity IN ('Critical', 'Major') AND a.logdate > {_A} - INTERVAL 6 DAY), "
    "tp AS (SELECT *, count(*) OVER (PARTITION BY equipmentid) AS n FROM ar WHERE status IS DISTINCT FROM 'RESOLVED' QUALIFY row_number() OVER (PARTITION BY equipmentid ORDER BY rk, logdate DESC, logid) = 1) "
    "SELECT lt.eqp_id, CASE WHEN EXISTS (SELECT 1 FROM ar WHERE ar.equipmentid = lt.eqp_id) THEN 3 WHEN NOT has_data OR is_stale THEN 0 WHEN state THEN 2 ELSE 1 END AS state, board_no, total_board, mo, factory, "
    "CAST(coalesce(tp.n, 0) AS INTEGER) AS alarm_count, tp.owner AS alarm_owner, tp.elapsed AS alarm_elapsed, tp.related_log_id AS alarm_related_log_id, CAST(floor(epoch_us(tp.logdate) / 1000) AS BIGINT) AS alarm_logdate_ms FROM lt LEFT JOIN tp ON tp.equipmentid = lt.eqp_id",
)
def _(t):
    return snapshot.machine_state(latest(t), t.alarms, t.catalog, t.lifecycle, AS_OF, "6 days")


@query(
    "al38_fleet_kpis", "devices tele alarms catalog",
    f"WITH {LATEST_SQL} SELECT {r('100.0 * count(*) FILTER (WHERE state) / NULLIF(count(*), 0)', 0)} AS availability_pct, count(*) FILTER (WHERE state) AS running, "
    f"(SELECT count(*) FROM alarms a JOIN catalog m ON m.alarm_code = a.errorcode WHERE a.logdate > {_A} - INTERVAL 10 DAY AND m.severity IN ('Critical', 'Major')) AS critical_major FROM lt",
)
def _(t):
    return snapshot.fleet_kpis(latest(t), t.alarms, t.catalog, AS_OF, "10 days")


@query("al37_machine_state_stored", same_as="al37_machine_state")
def _(t):
    return snapshot.machine_state(latest_stored(t), t.alarms, t.catalog, t.lifecycle, AS_OF, "6 days")


@query("al38_fleet_kpis_stored", same_as="al38_fleet_kpis")
def _(t):
    return snapshot.fleet_kpis(latest_stored(t), t.alarms, t.catalog, AS_OF, "10 days")


@query(
    "al60_not_producing", "devices tele alarms catalog",
    f"WITH {LATEST_SQL} SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM alarms a JOIN catalog m ON m.alarm_code = a.errorcode WHERE a.equipmentid = lt.eqp_id AND m.severity IN ('Critical', 'Major') AND a.logdate > {_A} - INTERVAL 6 DAY) "
    "OR NOT has_data OR is_stale OR NOT state) AS not_producing, count(*) AS machines FROM lt",
)
def _(t):
    return snapshot.not_producing(snapshot.machine_state(latest(t), t.alarms, t.catalog, t.lifecycle, AS_OF, "6 days"))


def _min(c: str) -> str:
    return r(f"avg({seconds(c, 'logdate')}) / 60", 1)


@query("al39_response_all_time", "orders_lifecycle", f"SELECT {_min('acknowledged_at')} AS mtta_min, {_min('resolved_at')} AS mttr_min FROM orders_lifecycle")
def _(t):
    return al.response_times(t.orders_lifecycle, window=None)


@query("al39_response_window", "lifecycle", f"SELECT {_min('acknowledged_at')} AS mtta_min, {_min('resolved_at')} AS mttr_min FROM lifecycle WHERE logdate > {_A} - INTERVAL 10 DAY")
def _(t):
    return al.response_times(t.lifecycle, AS_OF, "10 days")


@query("al39_response_daily", "orders_lifecycle", f"SELECT date_trunc('day', logdate) AS bucket, {_min('acknowledged_at')} AS mtta_min, {_min('resolved_at')} AS mttr_min FROM orders_lifecycle WHERE acknowledged_at IS NOT NULL OR resolved_at IS NOT NULL GROUP BY 1")
def _(t):
    return al.response_times(t.orders_lifecycle, window=None, grain="1 day")


@query(
    "al40_open_triage", "lifecycle alarms catalog",
    f"SELECT a.equipmentid AS machine, m.severity, m.alarm_msg AS alarm, l.logdate AS fired_at, {r(seconds(_A, 'l.logdate') + ' / 60', 1)} AS waiting_min FROM lifecycle l JOIN alarms a ON a.logdate = l.logdate AND a.logid = l.logid LEFT JOIN catalog m ON m.alarm_code = a.errorcode WHERE l.status = 'OPEN' ORDER BY l.logdate, l.logid LIMIT 20",
)
def _(t):
    return al.open_triage(t.lifecycle, t.alarms, t.catalog, AS_OF)


@query(
    "al41_lifecycle_quality", "lifecycle orders_lifecycle alarms",
    f"WITH l AS (SELECT * FROM lifecycle UNION ALL SELECT * FROM orders_lifecycle) SELECT count(*) FILTER (WHERE status = 'OPEN' AND logdate < {_A} - INTERVAL 4 HOUR) AS stuck_open, count(*) FILTER (WHERE status = 'ACKNOWLEDGED' AND acknowledged_at < {_A} - INTERVAL 2 HOUR) AS stuck_ack, "
    "(SELECT count(*) FROM l WHERE NOT EXISTS (SELECT 1 FROM alarms a WHERE a.logdate = l.logdate AND a.logid = l.logid)) AS orphans FROM l",
)
def _(t):
    return al.lifecycle_quality(t.lifecycle.unionByName(t.orders_lifecycle), t.alarms, AS_OF)


@query(
    "al43_burst_report", "alarms",
    "WITH g AS (SELECT equipmentid, errorcode, logdate - lag(logdate) OVER (PARTITION BY equipmentid, errorcode ORDER BY logdate, logid) AS gap FROM alarms) SELECT equipmentid, errorcode, count(*) AS repeats FROM g WHERE gap < INTERVAL 2 DAY GROUP BY 1, 2",
)
def _(t):
    return al.burst_report(t.alarms, "2 days", None)


@query("al48_code_lookup", "catalog", "SELECT alarm_id, alarm_type, alarm_msg, alarm_detail, severity, cause, impact, recovery_action, coalesce(sop_reference, 'Not yet available') AS sop_reference FROM catalog WHERE alarm_id = '90005' OR alarm_code = '90005' ORDER BY alarm_id LIMIT 1")
def _(t):
    return al.code_lookup(t.catalog, "90005")


@query("al48_recent_occurrences", "alarms", "SELECT logdate, equipmentid, logid, related_log_id, coalesce(link_basis, 'nearest') AS link_basis FROM alarms WHERE errorcode = '91009' ORDER BY logdate DESC, logid DESC LIMIT 20")
def _(t):
    return al.recent_occurrences(t.alarms, "91009")


@query("al56_alarm_pareto", "alarms", f"WITH c AS (SELECT errorcode, count(*) AS n FROM alarms GROUP BY 1) SELECT errorcode, n, {r('100.0 * sum(n) OVER (ORDER BY n DESC, errorcode) / sum(n) OVER ()', 2)} AS cum_pct FROM c")
def _(t):
    return al.alarm_pareto(t.alarms)


# ------------------------------------------------------------------------------------------ stateful, batch form

# cooldown folded per machine and code: an alarm fires when the last fired one is a cooldown back
_DEBOUNCE = (
    "WITH RECURSIVE s AS (SELECT equipmentid, errorcode, logid, epoch_us(logdate) AS t, row_number() OVER (PARTITION BY equipmentid, errorcode ORDER BY logdate, logid) AS rn FROM (alarms_)), "
    "f AS (SELECT equipmentid, errorcode, rn, logid, t AS last, true AS fired FROM s WHERE rn = 1 UNION ALL SELECT s.equipmentid, s.errorcode, s.rn, s.logid, CASE WHEN s.t - f.last >= {us} THEN s.t ELSE f.last END, s.t - f.last >= {us} "
    "FROM f JOIN s ON s.equipmentid = f.equipmentid AND s.errorcode = f.errorcode AND s.rn = f.rn + 1) "
)


def _debounce_sql(hours: int, select: str) -> str:
    sql = _DEBOUNCE.format(us=hours * 3600 * 1_000_000).replace("alarms_", view_sql("alarms"))
    return sql.replace("WITH RECURSIVE", "with recursive") + select


@query("sm6_debounce", "", _debounce_sql(96, "SELECT logid, fired FROM f"))
def _(t):
    return al.debounce(t.alarms, cooldown="96 hours").select("logid", "fired")


@query("sm6_debounce_doubling", same_as="sm6_debounce")
def _(t):
    return al.debounce(t.alarms, cooldown="96 hours", max_rows=3).select("logid", "fired")


@query("sm6_debounce_state", "", _debounce_sql(96, "SELECT equipmentid, errorcode, make_timestamp(min(last)) AS first_fired, make_timestamp(max(last)) AS last_fired, CAST(count(*) AS INTEGER) AS fire_count FROM f WHERE fired GROUP BY 1, 2"))
def _(t):
    return al.debounce_state(al.debounce(t.alarms, cooldown="96 hours"))


# every event of a user is an action on that user's first alarm
ACTIONS_SQL = (
    "SELECT a.logid, a.logdate, CASE e.event_type WHEN 'click' THEN 'ACKNOWLEDGED' WHEN 'purchase' THEN 'RESOLVED' WHEN 'view' THEN 'ACKNOWLEDGED' WHEN 'signup' THEN 'OPEN' ELSE 'RESOLVED' END AS action, "
    "CASE WHEN k % 3 = 0 THEN '' ELSE 'op' || CAST(k AS VARCHAR) END AS actor, 'n' || CAST(k AS VARCHAR) AS note, e.ts AS action_ts, lpad(CAST(e.event_id AS VARCHAR), 12, '0') AS action_id "
    "FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) e JOIN (SELECT min_by(logid, (logdate, logid)) AS logid, min(logdate) AS logdate, equipmentid FROM alarms GROUP BY equipmentid) a "
    "ON a.equipmentid = 'D' || CAST(e.user_id AS VARCHAR) AND e.ts > a.logdate"
)


def actions(t: Tables) -> DataFrame:
    first = t.alarms.groupBy("equipmentid").agg(F.min_by("logid", F.struct("logdate", "logid")).alias("logid"), F.min("logdate").alias("logdate"))
    ev = t.raw("events").withColumns({"k": F.get_json_object("props", "$.k").cast("int"), "equipmentid": F.concat(F.lit("D"), F.col("user_id").cast("string"))})
    action = F.when(F.col("event_type").isin("click", "view"), "ACKNOWLEDGED").when(F.col("event_type") == "signup", "OPEN").otherwise("RESOLVED")
    return ev.join(first, "equipmentid").where(F.col("ts") > F.col("logdate")).select(
        "logid", "logdate", action.alias("action"), F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit("op"), F.col("k").cast("string"))).alias("actor"),
        F.concat(F.lit("n"), F.col("k").cast("string")).alias("note"), F.col("ts").alias("action_ts"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("action_id"),
    )


_FOLD = (
    f"WITH ac AS ({ACTIONS_SQL}), rs AS (SELECT logid, logdate, min((action_ts, action_id)) AS o, min_by(actor, (action_ts, action_id)) AS by_, min_by(note, (action_ts, action_id)) AS note FROM ac WHERE action = 'RESOLVED' AND actor <> '' GROUP BY 1, 2), "
    "ak AS (SELECT ac.logid, ac.logdate, min((action_ts, action_id)) AS o, min_by(actor, (action_ts, action_id)) AS by_ FROM ac LEFT JOIN rs USING (logid, logdate) WHERE action = 'ACKNOWLEDGED' AND actor <> '' AND (rs.o IS NULL OR (action_ts, action_id) < rs.o) GROUP BY 1, 2) "
)


@query(
    "sm7_lifecycle_fold", "alarms",
    _FOLD + "SELECT a.logid, a.logdate, CASE WHEN rs.o IS NOT NULL THEN 'RESOLVED' WHEN ak.o IS NOT NULL THEN 'ACKNOWLEDGED' ELSE 'OPEN' END AS status, ak.o[1] AS acknowledged_at, ak.by_ AS acknowledged_by, rs.o[1] AS resolved_at, rs.by_ AS resolved_by, "
    "rs.note AS resolution_note, coalesce(rs.o[1], ak.o[1], a.logdate) AS updated_at FROM alarms a LEFT JOIN rs ON rs.logid = a.logid AND rs.logdate = a.logdate LEFT JOIN ak ON ak.logid = a.logid AND ak.logdate = a.logdate",
)
def _(t):
    return al.lifecycle_fold(t.alarms, actions(t))[0]


REJECTED_SQL = (
    "CASE WHEN rs.o IS NOT NULL AND (action_ts, action_id) > rs.o THEN 'RESOLVED is final' WHEN action = 'OPEN' THEN 'no transition to OPEN' WHEN actor = '' THEN 'actor required' "
    "WHEN action = 'ACKNOWLEDGED' AND ak.o IS NOT NULL AND (action_ts, action_id) > ak.o THEN 'not OPEN' END"
)


@query("sm7_lifecycle_rejected", "alarms", _FOLD + f", x AS (SELECT ac.*, {REJECTED_SQL} AS reason FROM ac LEFT JOIN rs USING (logid, logdate) LEFT JOIN ak USING (logid, logdate)) SELECT * FROM x WHERE reason IS NOT NULL")
def _(t):
    return al.lifecycle_fold(t.alarms, actions(t))[1]


_RULES = [("91008", "flag_temp_out_of_spec"), ("90005", "flag_pe_out_of_spec"), ("70004", "flag_scan_speed_out_of_spec"), ("91009", "flag_vac_out_of_spec")]


@query(
    "sm8_detect_alarms", "tele",
    f"WITH l AS (SELECT * FROM tele WHERE time > {_A} - INTERVAL 30 DAY QUALIFY row_number() OVER (PARTITION BY eqp_id ORDER BY time DESC, log_id DESC) = 1), "
    "x AS (" + " UNION ALL ".join(f"SELECT eqp_id, process, log_id, '{c}' AS errorcode FROM l WHERE {FLAGS_SQL[f]}" for c, f in _RULES) + ") "
    f"SELECT 'ALM-' || eqp_id || '-' || errorcode || '-' || log_id AS logid, {_A} AS logdate, errorcode, eqp_id AS equipmentid, process, log_id AS related_log_id, 'causal' AS link_basis FROM x",
)
def _(t):
    return snapshot.detect_alarms(t.tele, AS_OF, "30 days")


@query(
    "sm9_link_alarms", "alarms tele",
    "SELECT a.logid, t.log_id AS related_log_id, CASE WHEN t.log_id IS NOT NULL THEN 'nearest' END AS link_basis FROM alarms a LEFT JOIN LATERAL (SELECT log_id FROM tele t WHERE t.eqp_id = a.equipmentid AND t.time BETWEEN a.logdate - INTERVAL 2 HOUR AND a.logdate + INTERVAL 2 HOUR "
    "ORDER BY abs(epoch_us(t.time) - epoch_us(a.logdate)), t.time, t.log_id LIMIT 1) t ON true WHERE a.related_log_id IS NULL UNION ALL SELECT logid, related_log_id, 'causal' FROM alarms WHERE related_log_id IN (SELECT log_id FROM tele)",
)
def _(t):
    return al.link_alarms(t.alarms, t.tele, "2 hours")[0].select("logid", "related_log_id", "link_basis")


@query("sm9_link_rejected", "alarms tele", "SELECT logid, related_log_id FROM alarms WHERE related_log_id IS NOT NULL AND related_log_id NOT IN (SELECT log_id FROM tele)")
def _(t):
    return al.link_alarms(t.alarms, t.tele, "2 hours")[1].select("logid", "related_log_id")


# hourly evaluation of a fleet-wide condition per process
EVALS_SQL = "ev AS (SELECT process AS key, time_bucket(INTERVAL '1 hour', time) AS ts, avg(temperature) > 20.5 AS cond FROM tele GROUP BY 1, 2)"
SUSTAINED_SQL = (
    f"{EVALS_SQL}, b AS (SELECT *, cond AND NOT (coalesce(lag(cond) OVER w, false) AND coalesce(ts - lag(ts) OVER w, INTERVAL 9 DAY) <= INTERVAL 1 HOUR) AS st FROM ev WINDOW w AS (PARTITION BY key ORDER BY ts)), "
    "h AS (SELECT *, max(CASE WHEN st THEN ts END) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS since FROM b) SELECT key, ts, cond, CASE WHEN NOT cond THEN 'ok' WHEN ts - since >= INTERVAL 3 HOUR THEN 'firing' ELSE 'pending' END AS state FROM h"
)


def evaluations(t: Tables) -> DataFrame:
    return t.tele.groupBy(F.col("process").alias("key"), fn.time_bucket("time", "1 hour").alias("ts")).agg((F.avg("temperature") > 20.5).alias("cond"))


@query("sm10_sustained", "tele", f"WITH {SUSTAINED_SQL}")
def _(t):
    return al.sustained(evaluations(t), ["key"], "3 hours", "1 hour")


@query("sm10_sustained_split", same_as="sm10_sustained")
def _(t):
    return al.sustained(evaluations(t), ["key"], "3 hours", "1 hour", max_rows=50)


ALERTS_SQL = (
    "al AS (SELECT CASE event_type WHEN 'error' THEN 'ServiceDown' WHEN 'view' THEN 'ServiceHighLatency' WHEN 'click' THEN 'InterfaceDown' WHEN 'signup' THEN 'BandwidthSaturation' ELSE 'SLABreachWarning' END AS alertname, "
    "CASE WHEN k < 3 THEN 'critical' WHEN k < 90 THEN 'info' ELSE 'warning' END AS severity, 'D' || CAST(user_id AS VARCHAR) AS device_id, CASE WHEN user_id % 2 = 0 THEN 'ldi' ELSE 'server' END AS device_type, "
    "'I' || CAST(user_id AS VARCHAR) || '-' || CAST(k AS VARCHAR) AS instance, ts, event_id FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"
)


def alerts(t: Tables) -> DataFrame:
    ev = t.raw("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return ev.selectExpr(
        "CASE event_type WHEN 'error' THEN 'ServiceDown' WHEN 'view' THEN 'ServiceHighLatency' WHEN 'click' THEN 'InterfaceDown' WHEN 'signup' THEN 'BandwidthSaturation' ELSE 'SLABreachWarning' END AS alertname",
        "CASE WHEN k < 3 THEN 'critical' WHEN k < 90 THEN 'info' ELSE 'warning' END AS severity", "'D' || CAST(user_id AS STRING) AS device_id",
        "CASE WHEN user_id % 2 = 0 THEN 'ldi' ELSE 'server' END AS device_type", "'I' || CAST(user_id AS STRING) || '-' || CAST(k AS STRING) AS instance", "ts", "event_id",
    )


@query("sm11_group_alerts", "", f"WITH {ALERTS_SQL} SELECT alertname, device_id, device_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM al GROUP BY 1, 2, 3")
def _(t):
    return al.group_alerts(alerts(t))


@query(
    "sm11_inhibit", "",
    f"WITH {ALERTS_SQL} SELECT event_id, alertname, severity FROM al a WHERE NOT (alertname IN ('ServiceHighLatency', 'SLABreachWarning') AND instance IN (SELECT instance FROM al WHERE alertname = 'ServiceDown')) "
    "AND NOT (severity = 'warning' AND device_id IN (SELECT device_id FROM al WHERE severity = 'critical')) AND NOT (alertname = 'BandwidthSaturation' AND device_id IN (SELECT device_id FROM al WHERE alertname = 'InterfaceDown'))",
)
def _(t):
    return al.inhibit(alerts(t)).select("event_id", "alertname", "severity")


def alert_changes(t: Tables) -> DataFrame:
    """Every alert with its beginning and, ten minutes times a digit later, its end."""
    k = F.get_json_object("props", "$.k").cast("int")
    ends = t.raw("events").select("event_id", (1 + k % 7).alias("tens"))
    both = alerts(t).join(ends, "event_id").withColumn("firing", F.explode(F.array(F.lit(True), F.lit(False))))
    ts = F.when(F.col("firing"), F.col("ts")).otherwise(fn.ts_plus("ts", F.col("tens").cast("long") * 600_000_000))
    return both.select("device_id", "alertname", "device_type", "severity", "instance", F.col("event_id").cast("string").alias("alert_id"), ts.alias("ts"), "firing")


# looks at each group from its first alert's wait on: who is firing and not implied, who of those told of has ended
NOTIFY_SQL = (
    f"WITH RECURSIVE {ALERTS_SQL}, a AS (SELECT al.*, al.ts AS s, al.ts + INTERVAL 10 MINUTE * (1 + k % 7) AS e FROM al JOIN (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) USING (event_id)), "
    "im AS (SELECT a.event_id, list(struct_pack(s := b.s, e := b.e)) AS causes FROM a JOIN a b ON a.device_id = b.device_id AND b.s < a.e AND b.e > a.s AND ((b.alertname = 'ServiceDown' AND a.alertname IN ('ServiceHighLatency', 'SLABreachWarning') AND a.instance = b.instance) "
    "OR (b.severity = 'critical' AND a.severity = 'warning') OR (b.alertname = 'InterfaceDown' AND a.alertname = 'BandwidthSaturation')) GROUP BY 1), "
    "m AS (SELECT device_id, alertname, device_type, severity AS route, a.event_id, s, e, coalesce(causes, []) AS causes, INTERVAL 1 SECOND * CASE severity WHEN 'critical' THEN 10 ELSE 30 END AS wait, INTERVAL 1 MINUTE * CASE severity WHEN 'critical' THEN 5 WHEN 'warning' THEN 10 ELSE 30 END AS step, "
    "INTERVAL 1 MINUTE * CASE severity WHEN 'critical' THEN 30 WHEN 'warning' THEN 120 ELSE 1440 END AS again FROM a LEFT JOIN im USING (event_id)), "
    "z AS (SELECT device_id, alertname, device_type, route, min(s + wait) AS t, CAST([] AS BIGINT[]) AS told, CAST(NULL AS TIMESTAMP) AS last, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS reason, CAST(0 AS BIGINT) AS n_firing, CAST(0 AS BIGINT) AS n_resolved FROM m GROUP BY 1, 2, 3, 4 "
    "UNION ALL SELECT device_id, alertname, device_type, route, CASE WHEN alive > 0 THEN t + step ELSE coming + wait END, CASE WHEN alive = 0 THEN [] WHEN reason IS NULL THEN told ELSE firing END, CASE WHEN alive = 0 THEN NULL WHEN reason IS NULL THEN last ELSE t END, t, reason, len(firing), n_resolved FROM ("
    "SELECT *, CASE WHEN len(list_filter(firing, lambda f: NOT list_contains(told, f))) > 0 THEN CASE WHEN last IS NULL THEN 'firing' ELSE 'changed' END WHEN n_resolved > 0 THEN CASE WHEN len(firing) > 0 THEN 'changed' ELSE 'resolved' END WHEN len(firing) > 0 AND t - last >= again THEN 'repeat' END AS reason FROM ("
    "SELECT z.device_id, z.alertname, z.device_type, z.route, z.t, z.told, z.last, wait, step, again, count(*) FILTER (s <= z.t AND e > z.t) AS alive, min(s) FILTER (s > z.t) AS coming, count(*) FILTER (e <= z.t AND list_contains(z.told, event_id)) AS n_resolved, "
    "coalesce(list(event_id) FILTER (s <= z.t AND e > z.t AND len(list_filter(causes, lambda b: b.s <= z.t AND b.e > z.t)) = 0), []) AS firing FROM z JOIN m ON m.device_id = z.device_id AND m.alertname = z.alertname AND m.device_type = z.device_type AND m.route = z.route "
    f"WHERE z.t <= {_A} GROUP BY ALL))) SELECT device_id, alertname, device_type, route, ts, reason, n_firing, n_resolved FROM z WHERE reason IS NOT NULL"
)


@query("sm11_notifications", "", NOTIFY_SQL)
def _(t):
    return notifications(alert_changes(t), AS_OF)


# a counter that falls back to zero now and then; each step counts in the bucket of its later reading
RESETTING_SQL = (
    "rt AS (SELECT event_type AS key, bucket, sum(CASE WHEN before IS NULL THEN 0 WHEN v >= before THEN v - before ELSE v END) / 21600.0 AS rate FROM (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY ts, v) AS before "
    "FROM (SELECT event_type, ts, time_bucket(INTERVAL '6 hours', ts) AS bucket, event_id % 50 AS v FROM events)) GROUP BY 1, 2)"
)
_RATE = RESETTING_SQL


@query(
    "sm12_rate_degraded", "",
    f"WITH {_RATE}, m AS (SELECT *, avg(rate) OVER (PARTITION BY key ORDER BY bucket ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS mr FROM rt) SELECT key, bucket, {r('rate', 4)} AS rate, {r('mr', 4)} AS mean_rate, CASE WHEN rate = 0 THEN 'STALLED' WHEN {r('rate - mr * 0.9', 6)} < 0 THEN 'DEGRADED' ELSE 'OK' END AS status FROM m",
)
def _(t):
    rates = infra.rate_over(readings(t), ["key"], "ts", "v", "6 hours")
    return infra.rate_degraded(rates, ["key"], 12, 0.9)


@query(
    "sm12_failure_rate", "",
    f"WITH {RESETTING_SQL}, m AS (SELECT *, rate > 0.01 AS cond FROM rt), b AS (SELECT *, CASE WHEN cond AND NOT (coalesce(lag(cond) OVER w, false) AND bucket - lag(bucket) OVER w <= INTERVAL 6 HOUR) THEN bucket END AS since FROM m WINDOW w AS (PARTITION BY key ORDER BY bucket)), "
    f"h AS (SELECT *, bucket - max(since) OVER (PARTITION BY key ORDER BY bucket) AS held FROM b) SELECT key, bucket AS ts, {r('rate', 4)} AS rate, CASE WHEN NOT cond THEN 'ok' WHEN held >= INTERVAL 12 HOUR THEN 'firing' ELSE 'pending' END AS state FROM h",
)
def _(t):
    rates = infra.rate_over(readings(t), ["key"], "ts", "v", "6 hours")
    return infra.rate_alerts(rates, ["key"], 0.01, "12 hours", "6 hours")


def readings(t: Tables) -> DataFrame:
    return t.raw("events").select(F.col("event_type").alias("key"), "ts", (F.col("event_id") % 50).alias("v"))


# runs of a condition over buckets that follow each other, and for how long they have held
_HELD = "CASE WHEN {c} AND NOT (coalesce(lag({c}) OVER w, false) AND bucket - lag(bucket) OVER w <= INTERVAL 1 HOUR) THEN bucket END AS since_{c}"
_TOLD = "CASE WHEN NOT {c} THEN 'ok' WHEN bucket - max(since_{c}) OVER (PARTITION BY key ORDER BY bucket) >= INTERVAL {h} HOUR THEN 'firing' ELSE 'pending' END AS {c}"


@query(
    "sm12_pipeline_rules", "",
    f"WITH {RESETTING_SQL.replace('6 hours', '1 hour').replace('21600.0', '3600.0')}, m AS (SELECT *, avg(rate) OVER (PARTITION BY key ORDER BY bucket RANGE BETWEEN INTERVAL '11 hours' PRECEDING AND CURRENT ROW) AS mr FROM rt), "
    f"c AS (SELECT *, rate = 0 AS stalled, rate > 0 AND {r('rate - mr * 0.9', 6)} < 0 AS degraded FROM m), b AS (SELECT *, {_HELD.format(c='stalled')}, {_HELD.format(c='degraded')} FROM c WINDOW w AS (PARTITION BY key ORDER BY bucket)) "
    f"SELECT key, bucket, {r('rate', 4)} AS rate, {r('mr', 4)} AS mean_rate, {_TOLD.format(c='stalled', h=2)}, {_TOLD.format(c='degraded', h=3)} FROM b",
)
def _(t):
    rates = infra.rate_over(readings(t), ["key"], "ts", "v", "1 hour")
    return infra.pipeline_rules(rates, ["key"], "1 hour", "12 hours", 0.9, "2 hours", "3 hours")


@query("sm13_lateness_report", "alarms", f"SELECT link_basis, count(*) AS n, count(*) FILTER (WHERE ingest_ts < logdate) AS ingest_before_source, count(*) FILTER (WHERE logdate > {_A} - INTERVAL 2 DAY) AS future, count(*) FILTER (WHERE ingest_ts IS NULL) AS unstamped FROM alarms GROUP BY 1")
def _(t):
    return quality.lateness_report(t.alarms, "logdate", "ingest_ts", "2024-01-29 00:00:00", ["link_basis"])


_HALF = (
    "with recursive s AS (SELECT device_id, event_id, temp_c AS x, row_number() OVER (PARTITION BY device_id ORDER BY time, event_id) AS rn FROM (sysm_)), z AS (SELECT device_id, rn, event_id, x AS z FROM s WHERE rn = 1 "
    "UNION ALL SELECT s.device_id, s.rn, s.event_id, CASE WHEN z.z = 0 THEN s.x ELSE (z.z + s.x) / 2 END FROM z JOIN s ON s.device_id = z.device_id AND s.rn = z.rn + 1) SELECT event_id, " + r("z", 4) + " AS level FROM z"
).replace("sysm_", view_sql("sysm"))


@query("sm4_half_average", "", _HALF)
def _(t):
    from ..sources.varbinds import half_average

    out = half_average(t.sysm.select("device_id", "time", "event_id", "temp_c"), ["device_id"], ["time", "event_id"], "temp_c", "level")
    return out.select("event_id", fn.rnd("level", 4).alias("level"))


@query(
    "sm4_carry_forward", "tele",
    "SELECT log_id, round(last(air_vacuum IGNORE NULLS) OVER w, 4) AS air_vacuum, last(pe_6 IS NULL) OVER (PARTITION BY log_id) AS pe_missing FROM tele WINDOW w AS (PARTITION BY eqp_id ORDER BY time, log_id ROWS UNBOUNDED PRECEDING)",
)
def _(t):
    from ..operators.series import carry_forward

    rows = t.tele.select("time", "eqp_id", "log_id", "air_vacuum", F.col("pe_6").isNull().alias("pe_missing"))
    return carry_forward(rows, ["eqp_id"], ["time", "log_id"], ["air_vacuum"]).select("log_id", F.round("air_vacuum", 4).alias("air_vacuum"), "pe_missing")


@query("sm4_carry_forward_split", same_as="sm4_carry_forward")
def _(t):
    from ..operators.series import carry_forward

    rows = t.tele.select("time", "eqp_id", "log_id", "air_vacuum", F.col("pe_6").isNull().alias("pe_missing"))
    return carry_forward(rows, ["eqp_id"], ["time", "log_id"], ["air_vacuum"], 7).select("log_id", F.round("air_vacuum", 4).alias("air_vacuum"), "pe_missing")


CYCLE_SQL = (
    "WITH g AS (SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER w >= INTERVAL 1 HOUR, true) THEN 1 ELSE 0 END AS st FROM cycles WINDOW w AS (PARTITION BY device_id ORDER BY ts)), c AS (SELECT *, sum(st) OVER (PARTITION BY device_id ORDER BY ts) AS cy FROM g) "
    "SELECT device_id, min(ts) AS cycle_start, max(ts) AS last_part, array_to_string(list_sort(list_distinct(list(walker))), ',') AS walkers, max_by(cpu, ts) FILTER (WHERE cpu IS NOT NULL) AS cpu, max_by(temp, ts) FILTER (WHERE temp IS NOT NULL) AS temp FROM c GROUP BY device_id, cy"
)


@query("sm5_assemble_cycle", "cycles", CYCLE_SQL)
def _(t):
    from ..streaming.jobs import assemble_cycle

    out = assemble_cycle(t.cycles.drop("event_id"), "1 hour")
    return out.withColumn("walkers", F.array_join("walkers", ","))


# a pass over each device's parts: a cycle closes when its three walkers have reported, or a day and a half after it began
POLL_SQL = (
    "WITH RECURSIVE s AS (SELECT *, CASE walker WHEN 'cpu' THEN 1 WHEN 'storage' THEN 2 ELSE 4 END AS bit, row_number() OVER (PARTITION BY device_id ORDER BY ts, event_id) AS rn FROM cycles WHERE walker IN ('cpu', 'storage', 'temp')), "
    "z AS (SELECT device_id, rn, rn AS cycle, ts AS since, bit AS seen FROM s WHERE rn = 1 UNION ALL SELECT device_id, rn, CASE WHEN fresh THEN rn ELSE cycle END, CASE WHEN fresh THEN ts ELSE since END, CASE WHEN fresh THEN bit ELSE seen | bit END "
    "FROM (SELECT s.*, z.cycle, z.since, z.seen, z.seen = 7 OR s.ts - z.since >= INTERVAL 36 HOUR AS fresh FROM z JOIN s ON s.device_id = z.device_id AND s.rn = z.rn + 1)) "
    "SELECT device_id, min(ts) AS cycle_start, CASE WHEN max(seen) = 7 THEN max(ts) ELSE min(ts) + INTERVAL 36 HOUR END AS closed_at, max(seen) = 7 AS complete, array_to_string(list_sort(list_distinct(list(walker))), ',') AS walkers, "
    "max_by(cpu, ts) FILTER (WHERE cpu IS NOT NULL) AS cpu, max_by(temp, ts) FILTER (WHERE temp IS NOT NULL) AS temp FROM s JOIN z USING (device_id, rn) GROUP BY device_id, cycle"
)


@query("sm5_poll_cycle", "", POLL_SQL.replace("FROM cycles", f"FROM ({view_sql('cycles')})"))
def _(t):
    out = poll_cycles(t.cycles, "36 hours", tie="event_id")
    return out.withColumn("walkers", F.array_join("walkers", ","))


@query("sm5_poll_cycle_split", same_as="sm5_poll_cycle")
def _(t):
    out = poll_cycles(t.cycles, "36 hours", tie="event_id", max_rows=7)
    return out.withColumn("walkers", F.array_join("walkers", ","))


# ------------------------------------------------------------------------------------------ data quality

_MS = "(epoch_us(ingest_ts) - epoch_us({c})) / 1000.0"


def _lat(c: str) -> str:
    ps = ", ".join(f"{r(f'quantile_cont({_MS.format(c=c)}, {p})', 3)} AS {n}" for n, p in quality.LATENCY_PROBS.items())
    return f"count(*) AS n, {ps}"


@query("al42_ingest_latency", "tele", f"SELECT process, {_lat('time')} FROM tele GROUP BY 1")
def _(t):
    return quality.ingest_latency(t.tele, "time", keys=["process"])


@query("al42_ingest_latency_basis", "alarms", f"SELECT link_basis, {_lat('logdate')} FROM alarms WHERE logdate > {_A} - INTERVAL 20 DAY GROUP BY 1")
def _(t):
    return quality.ingest_latency(t.alarms, "logdate", keys=["link_basis"], as_of=AS_OF, window="20 days")


@query("al42_ingest_latency_series", "tele", f"SELECT time_bucket(INTERVAL '1 hour', time) AS bucket, {_lat('time')} FROM tele GROUP BY 1")
def _(t):
    return quality.ingest_latency(t.tele, "time", grain="1 hour")


@query("al42_ingest_latency_total", "sysm", f"SELECT {_lat('time')} FROM sysm")
def _(t):
    return quality.ingest_latency(t.sysm, "time")


@query("al46_expected_rows", "sysm", f"SELECT device_id, count(*) AS n, CAST(60 AS DOUBLE) AS expected, {r('count(*) * 100.0 / 60', 2)} AS pct FROM sysm WHERE time BETWEEN TIMESTAMP '2024-01-01' AND {_A} GROUP BY 1")
def _(t):
    return quality.expected_rows(t.sysm, "device_id", "time", "12 hours", "2024-01-01", AS_OF)


_GAP = "(epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY eqp_id ORDER BY time, log_id)) / 1000000.0"


@query("al46_gap_report", "tele", f"WITH g AS (SELECT eqp_id, {_GAP} AS g FROM tele) SELECT eqp_id, count(*) AS n, {r('min(g)', 3)} AS min_gap, {r('avg(g)', 3)} AS avg_gap, {r('max(g)', 3)} AS max_gap FROM g GROUP BY 1")
def _(t):
    return quality.gap_report(t.tele, "eqp_id", "time", "log_id")


@query(
    "al46_empty_buckets", "tele",
    "WITH k AS (SELECT DISTINCT process FROM tele), g AS (SELECT process, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:45:00', INTERVAL 15 MINUTE)) AS bucket FROM k) SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM (SELECT process AS p, time_bucket(INTERVAL '15 minutes', time) AS b FROM tele) s WHERE s.p = g.process AND s.b = g.bucket)",
)
def _(t):
    return quality.empty_buckets(t.tele, t.tele.select("process").distinct(), "process", "time", "2024-01-01", AS_OF)


@query("al46_recent_activity", "sysm", f"SELECT device_id, count(*) AS n, max(time) AS latest FROM sysm WHERE time > {_A} - INTERVAL 3 DAY GROUP BY 1")
def _(t):
    return quality.recent_activity(t.sysm, "device_id", "time", AS_OF, "3 days")


@query("al47_placeholder_text", "catalog", f"SELECT alarm_id, alarm_msg, alarm_detail FROM catalog WHERE regexp_matches(alarm_msg, '{quality.PLACEHOLDER}', 'i') OR alarm_msg = '' OR alarm_msg IS NULL OR alarm_detail = '' OR length(alarm_detail) < 5")
def _(t):
    return quality.placeholder_text(t.catalog)


@query("al47_duplicate_messages", "catalog", "SELECT alarm_msg, count(*) AS n FROM catalog GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return quality.duplicate_messages(t.catalog)


@query("al47_orphan_codes", "alarms catalog", "SELECT errorcode, count(*) AS n FROM alarms WHERE errorcode NOT IN (SELECT alarm_code FROM catalog) GROUP BY 1")
def _(t):
    return quality.orphan_codes(t.alarms, t.catalog)


@query(
    "al47_category_coverage", "alarms catalog",
    f"WITH f AS (SELECT DISTINCT errorcode FROM alarms), k AS (SELECT DISTINCT alarm_code FROM catalog WHERE {CATEGORY_SQL.format(c='alarm_code')} <> 'UNCLASSIFIED') SELECT count(*) AS codes, count(k.alarm_code) AS categorised, {r('100.0 * count(k.alarm_code) / count(*)', 1)} AS coverage_pct, 100.0 * count(k.alarm_code) / count(*) >= 45 AS ok FROM f LEFT JOIN k ON k.alarm_code = f.errorcode",
)
def _(t):
    return quality.category_coverage(t.alarms, rca.alarm_category(t.catalog))


@query(
    "al53_reconcile", "",
    "WITH a AS (SELECT o_orderkey AS id, o_custkey AS c, o_totalprice AS p FROM orders), b AS (SELECT o_orderkey AS id, o_custkey AS c, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderpriority <> '5-LOW') "
    "SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b, (SELECT count(*) FROM a WHERE id NOT IN (SELECT id FROM b)) AS only_a, (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM a)) AS only_b, (SELECT count(*) FROM a JOIN b USING (id) WHERE a.p <> b.p OR a.c <> b.c) AS changed",
)
def _(t):
    o = t.raw("orders")
    a = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("p"))
    b = o.where(F.col("o_orderpriority") != "5-LOW").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("p")
    )
    return quality.reconcile(a, b, ["id"])


@query(
    "al59_ingest_throughput", "",
    f"SELECT event_type AS target_table, time_bucket(INTERVAL '1 day', ts) AS bucket, {r('coalesce(sum(CASE WHEN k % 7 <> 0 THEN k END), 0) / 86400.0', 4)} AS rows_per_sec, {r('100.0 * count(*) FILTER (WHERE k % 7 <> 0) / count(*)', 2)} AS success_pct FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) GROUP BY 1, 2",
)
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    ledger = t.raw("events").select(F.col("event_type").alias("target_table"), F.col("ts").alias("staged_at"), F.when(k % 7 != 0, "committed").otherwise("failed").alias("status"), k.alias("row_count"))
    return quality.pipeline_throughput(ledger, "1 day")


@query("mnt4_enforce_fk", "tele devices", "SELECT log_id, CASE WHEN eqp_id IN (SELECT device_id FROM devices WHERE enabled) THEN 'accepted' ELSE 'quarantined' END AS verdict FROM tele")
def _(t):
    from ..sources.maintenance import enforce_fk

    ok, bad = enforce_fk(t.tele.select("log_id", "eqp_id"), t.devices.where("enabled"), "eqp_id")
    return ok.select("log_id", F.lit("accepted").alias("verdict")).unionByName(bad.select("log_id", F.lit("quarantined").alias("verdict")))

