"""Projections, filters, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import aggregates as agg
from ..operators import control, infra, joins, series, spc
from ..schema import JE_COLS, PE_COLS
from .registry import query, r, seconds
from .tables import AS_OF, CATEGORY_SQL, Tables

_A = f"TIMESTAMP '{AS_OF}'"
_PE = ", ".join(PE_COLS)
_ABS_PE0 = "greatest(" + ", ".join(f"abs(coalesce({c}, 0))" for c in PE_COLS) + ")"
_ABS_PE = "greatest(" + ", ".join(f"abs({c})" for c in PE_COLS) + ")"
_ABS_JE = "greatest(" + ", ".join(f"abs({c})" for c in JE_COLS) + ")"
FLAGS_SQL = {
    "flag_thermal_out_of_spec": "(temperature < 20 OR temperature > 24)",
    "flag_humidity_out_of_spec": "(humidity < 50 OR humidity > 60)",
    "flag_vac_out_of_spec": "(air_vacuum IS NOT NULL AND (air_vacuum > -8 OR air_vacuum < -30))",
    "flag_pe_out_of_spec": "(abs(pe_1) > 10 OR abs(je_1) > 10)",
    "flag_scan_speed_out_of_spec": "(scan_speed > 450 OR scan_speed <= 0)",
    "flag_exposure_out_of_spec": "(resist_dosage > 650 OR resist_dosage <= 0)",
    "flag_temp_out_of_spec": "(temperature < 20 OR temperature > 24 OR humidity < 50 OR humidity > 60)",
}
FLAG_LIST = ", ".join(f"{e} AS {n}" for n, e in FLAGS_SQL.items())
UNPIVOT_PE = "SELECT {keep}, unnest([" + _PE + "]) AS sample FROM tele"
# rows whose group is too big are cut into chunks; this size forces the cut on the small test tables
TINY = 64


# ------------------------------------------------------------------------------------------ projections

@query("prj1_spec_flags", "tele", f"SELECT log_id, {FLAG_LIST} FROM tele")
def _(t: Tables) -> DataFrame:
    return fn.spec_flags(t.tele).select("log_id", *FLAGS_SQL)


@query("prj2_max_abs_zero", "tele", f"SELECT log_id, {r(_ABS_PE0, 4)} AS max_pe FROM tele")
def _(t):
    return t.tele.select("log_id", fn.rnd(fn.max_abs(PE_COLS), 4).alias("max_pe"))


@query("prj3_max_abs_present", "tele", f"SELECT log_id, {r(_ABS_JE, 4)} AS max_je FROM tele")
def _(t):
    return t.tele.select("log_id", fn.rnd(fn.max_abs(JE_COLS, coalesce0=False), 4).alias("max_je"))


@query("prj4_row_mean", "tele", f"SELECT log_id, {r('list_avg([' + _PE + '])', 4)} AS mean_pe FROM tele")
def _(t):
    return t.tele.select("log_id", fn.rnd(fn.row_mean(PE_COLS), 4).alias("mean_pe"))


@query("prj5_unpivot_samples", "tele", f"WITH u AS ({UNPIVOT_PE.format(keep='log_id')}) SELECT log_id, {r('sample', 4)} AS sample FROM u WHERE sample IS NOT NULL")
def _(t):
    return spc.unpivot_samples(t.tele, PE_COLS, ["log_id"]).withColumn("sample", fn.rnd("sample", 4))


@query("prj6_safe_ratio", "legacy", f"SELECT row_id, {r('throughput / NULLIF(uptime, 0) * 100', 4)} AS pct FROM legacy")
def _(t):
    return t.legacy.select("row_id", fn.rnd(fn.pct("throughput", "uptime"), 4).alias("pct"))


_HEALTH = "greatest(0, 100 - greatest(0, cpu_load_percent - 70) * 1.5 - greatest(0, ram_used_mb / ram_total_mb * 100 - 75) * 2 - greatest(0, disk_used_gb / disk_total_gb * 100 - 80) * 2)"


@query("prj7_health_score", "sysm", f"SELECT event_id, {r(_HEALTH, 1)} AS health_score FROM sysm")
def _(t):
    ram, disk = fn.pct("ram_used_mb", "ram_total_mb"), fn.pct("disk_used_gb", "disk_total_gb")
    return t.sysm.select("event_id", fn.rnd(fn.health_score(F.col("cpu_load_percent"), ram, disk), 1).alias("health_score"))


CLASS_SQL = "CASE WHEN {c} IS NULL THEN NULL WHEN {c} >= 2.0 THEN 'World Class' WHEN {c} >= 1.67 THEN 'Excellent' WHEN {c} >= 1.33 THEN 'Capable' WHEN {c} >= 1.0 THEN 'Marginally Capable' ELSE 'Not Capable' END"


@query("prj8_capability_class", "probes", f"SELECT probe_id, {CLASS_SQL.format(c='duration_s')} AS class FROM probes")
def _(t):
    return t.probes.select("probe_id", fn.capability_class(F.col("duration_s")).alias("class"))


@query("prj9_freshness", "tele", "SELECT log_id, CASE WHEN total_time <= 30 THEN 'online' WHEN total_time <= 300 THEN 'stale' ELSE 'offline' END AS band FROM tele")
def _(t):
    return t.tele.select("log_id", fn.freshness(F.col("total_time")).alias("band"))


@query(
    "prj10_validate_bounds", "tele",
    f"SELECT log_id, {r('CASE WHEN total_time BETWEEN -40 AND 150 THEN total_time END', 4)} AS temperature, {r('CASE WHEN humidity BETWEEN 0 AND 100 THEN humidity END', 4)} AS humidity, "
    f"{r('CASE WHEN scan_speed * 100 BETWEEN 0 AND 100000 THEN scan_speed * 100 END', 4)} AS mbps, {r('CASE WHEN pe_5 * 10 BETWEEN -100 AND 100 THEN pe_5 * 10 END', 4)} AS pe FROM tele",
)
def _(t):
    raw = t.tele.select("log_id", F.col("total_time").cast("string").alias("temperature"), F.col("humidity").cast("string").alias("humidity"), (F.col("scan_speed") * 100).alias("mbps"), (F.col("pe_5") * 10).alias("pe"))
    kinds = {"temperature": "temperature", "humidity": "percent", "mbps": "mbps", "pe": "position_error"}
    return fn.validate_bounds(raw, kinds).withColumns({c: fn.rnd(c, 4) for c in kinds})


@query(
    "prj11_clamp_units", "tele",
    f"SELECT log_id, {r('greatest(0, least(100, coalesce(pe_5 * 5, 0)))', 4)} AS pct, {r('total_time * 1e6 / 1024', 2)} AS kb, {r('total_time * 1e6 / 1048576', 2)} AS mb, "
    f"{r('total_time * 1e9 / 1073741824', 2)} AS gb, {r('total_time * 1e12 / 1099511627776', 2)} AS tb, {r('total_time * 1e6 * 8 / 1e6', 2)} AS mbps FROM tele",
)
def _(t):
    b = F.col("total_time")
    return t.tele.select(
        "log_id", fn.rnd(fn.clamp(F.col("pe_5") * 5, 0, 100), 4).alias("pct"), fn.convert_units(b * 1e6, "KB").alias("kb"), fn.convert_units(b * 1e6, "MB").alias("mb"),
        fn.convert_units(b * 1e9, "GB").alias("gb"), fn.convert_units(b * 1e12, "TB").alias("tb"), fn.convert_units(b * 1e6, "Mbps").alias("mbps"),
    )


@query(
    "sc1_scalar_text", "alarms",
    f"WITH a AS (SELECT *, {seconds(_A, 'logdate')} AS s FROM alarms) SELECT logid, CASE WHEN s < 3600 THEN CAST(CAST(floor(s / 60) AS INTEGER) AS VARCHAR) || 'm' ELSE "
    "CAST(CAST(floor(s / 3600) AS BIGINT) % 24 AS VARCHAR) || 'h' || lpad(CAST(CAST(floor(s / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') || 'm' END AS elapsed, "
    "regexp_replace(equipmentid || ' ' || errorcode || '/x', '[^a-zA-Z0-9_-]', '_', 'g') AS key, replace('1,3,6,' || errorcode, ',', '.') AS oid, "
    "CAST(round(CAST(s / 60 AS DECIMAL(38,6)), 0) AS INTEGER) AS minutes FROM a",
)
def _(t):
    age = fn.seconds_between(fn.ts_lit(AS_OF), F.col("logdate"))
    return t.alarms.select(
        "logid", fn.elapsed_text(age).alias("elapsed"), fn.safe_key(F.concat("equipmentid", F.lit(" "), "errorcode", F.lit("/x"))).alias("key"),
        fn.normalize_oid(F.concat(F.lit("1,3,6,"), "errorcode")).alias("oid"), fn.pg_int(age / 60).alias("minutes"),
    )


# ------------------------------------------------------------------------------------------ filters

@query("flt1_last_window", "tele", f"SELECT log_id, time FROM tele WHERE time > {_A} - INTERVAL 7 DAY")
def _(t):
    return fn.last(t.tele, "time", "7 days", AS_OF).select("log_id", "time")


@query("flt2_last_of_data", "tele", "SELECT log_id, time FROM tele WHERE time > (SELECT max(time) - INTERVAL 36 HOUR FROM tele)")
def _(t):
    return fn.last_of_data(t.tele, "time", "36 hours").select("log_id", "time")


@query("flt3_time_range", "tele", "SELECT log_id FROM tele WHERE time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'")
def _(t):
    return fn.time_range(t.tele, "time", "2024-01-05", "2024-01-20 12:00:00").select("log_id")


@query("flt4_in_or_all", "tele", "SELECT log_id, factory, mo FROM tele WHERE factory IN ('1', '3')")
def _(t):
    return t.tele.where(fn.in_or_all("factory", ["1", "3"]) & fn.in_or_all("mo", None)).select("log_id", "factory", "mo")


@query("flt5_is_distinct", "tele", "SELECT log_id FROM tele WHERE pe_6 IS DISTINCT FROM pe_1")
def _(t):
    return t.tele.where(fn.is_distinct(F.col("pe_6"), F.col("pe_1"))).select("log_id")


@query("flt6_scope_devices", "sysm devices", "SELECT event_id, device_id FROM sysm WHERE device_id IN (SELECT device_id FROM devices WHERE enabled AND device_type = 'server')")
def _(t):
    return fn.scope_devices(t.sysm, t.devices, "server").select("event_id", "device_id")


@query("flt7_having_min_samples", "tele", f"SELECT eqp_id, count(*) AS n, {r('avg(temperature)', 4)} AS avg_temp FROM tele GROUP BY 1 HAVING count(*) >= 45")
def _(t):
    return t.tele.groupBy("eqp_id").agg(F.count(F.lit(1)).alias("n"), fn.rnd(F.avg("temperature"), 4).alias("avg_temp")).where(F.col("n") >= 45)


# ------------------------------------------------------------------------------------------ joins

@query("jn1_join_dim", "sysm devices", "SELECT s.event_id, d.hostname, d.location FROM sysm s JOIN devices d USING (device_id)")
def _(t):
    return joins.join_dim(t.sysm, t.devices, "device_id").select("event_id", "hostname", "location")


@query("jn2_join_catalog", "alarms catalog", "SELECT a.logid, a.errorcode, c.alarm_msg, c.severity FROM alarms a LEFT JOIN catalog c ON c.alarm_code = a.errorcode")
def _(t):
    return joins.join_catalog(t.alarms, t.catalog).select("logid", "errorcode", "alarm_msg", "severity")


@query("jn3_registry_left", "tele devices", "SELECT d.device_id AS eqp_id, d.location, s.n FROM devices d LEFT JOIN (SELECT eqp_id, count(*) AS n FROM tele GROUP BY 1) s ON s.eqp_id = d.device_id")
def _(t):
    stats = t.tele.groupBy("eqp_id").agg(F.count(F.lit(1)).alias("n"))
    return joins.registry_left(t.devices.select(F.col("device_id").alias("eqp_id"), "location"), stats, "eqp_id")


@query(
    "jn4_full_outer_coalesce", "tele alarms",
    "SELECT coalesce(p.eqp_id, q.eqp_id) AS eqp_id, coalesce(p.day, q.day) AS day, p.n, q.n_alarms FROM (SELECT eqp_id, date_trunc('day', time) AS day, count(*) AS n FROM tele GROUP BY 1, 2) p "
    "FULL OUTER JOIN (SELECT equipmentid AS eqp_id, date_trunc('day', logdate) AS day, count(*) AS n_alarms FROM alarms GROUP BY 1, 2) q ON p.eqp_id = q.eqp_id AND p.day = q.day",
)
def _(t):
    p = t.tele.groupBy("eqp_id", F.date_trunc("day", "time").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    q = t.alarms.groupBy(F.col("equipmentid").alias("eqp_id"), F.date_trunc("day", "logdate").alias("day")).agg(F.count(F.lit(1)).alias("n_alarms"))
    return joins.full_outer_coalesce(p, q, ["eqp_id", "day"])


_NEAR = """SELECT a.logid, t.log_id, t.time AS tele_time FROM alarms a LEFT JOIN LATERAL (
  SELECT log_id, time FROM tele t WHERE t.eqp_id = a.equipmentid AND t.time BETWEEN a.logdate - INTERVAL {tol} AND a.logdate + INTERVAL {tol}
  ORDER BY abs(epoch_us(t.time) - epoch_us(a.logdate)), t.time, t.log_id LIMIT 1) t ON true"""


@query("jn5_asof_nearest", "alarms tele", _NEAR.format(tol="6 HOUR"))
def _(t):
    return joins.asof_nearest(t.alarms, t.tele, "equipmentid", "logdate", "6 hours", {"log_id": "log_id", "tele_time": "time"}, right_by="eqp_id", right_ts="time").select("logid", "log_id", "tele_time")


@query("jn5_asof_nearest_pruned", same_as="jn5_asof_nearest")
def _(t):
    return joins.asof_nearest(t.alarms, t.tele, "equipmentid", "logdate", "6 hours", {"log_id": "log_id", "tele_time": "time"}, right_by="eqp_id", right_ts="time", prune=True).select("logid", "log_id", "tele_time")


@query(
    "jn6_asof_backward", "alarms tele",
    "SELECT a.logid, t.log_id, t.time AS tele_time FROM alarms a LEFT JOIN LATERAL (SELECT log_id, time FROM tele t WHERE t.eqp_id = a.equipmentid AND t.time <= a.logdate "
    "AND t.time >= a.logdate - INTERVAL 5 HOUR ORDER BY t.time DESC, t.log_id LIMIT 1) t ON true",
)
def _(t):
    return joins.asof_backward(t.alarms, t.tele, "equipmentid", "logdate", "5 hours", {"log_id": "log_id", "tele_time": "time"}, right_by="eqp_id", right_ts="time").select("logid", "log_id", "tele_time")


def cascade_sql(cols: list[str]) -> str:
    """CTE `d`: each alarm with the telemetry row it names, if that lies in the bound, or else, without a name, the last one of its machine."""
    take = "".join(f", tele.{c}" for c in cols)
    named = f"SELECT alarms.logid, 'exact' AS match_type, tele.log_id AS hit{take}, 1 AS place FROM tele JOIN alarms ON related_log_id = tele.log_id WHERE tele.time - logdate BETWEEN -INTERVAL 10 MINUTE AND INTERVAL 1 MINUTE"
    nearby = (
        f"SELECT alarms.logid, 'nearest' AS match_type, tele.log_id AS hit{take}, row_number() OVER (PARTITION BY alarms.logid ORDER BY logdate - tele.time, tele.log_id) AS place "
        "FROM tele JOIN alarms ON equipmentid = eqp_id WHERE related_log_id IS NULL AND logdate - tele.time BETWEEN INTERVAL 0 HOUR AND INTERVAL 5 HOUR"
    )
    return f"hits AS ({named} UNION ALL {nearby}), d AS (SELECT alarms.*, hits.* EXCLUDE (logid, place) FROM alarms LEFT JOIN hits ON hits.logid = alarms.logid AND hits.place = 1)"


@query("jn7_asof_exact_or_backward", "alarms tele", f"WITH {cascade_sql(['temperature'])} SELECT logid, match_type, {r('temperature', 4)} AS temperature FROM d")
def _(t):
    out = joins.asof_exact_or_backward(t.alarms, t.tele, {"temperature": "temperature"}, back="5 hours")
    return out.select("logid", "match_type", fn.rnd("temperature", 4).alias("temperature"))


@query(
    "jn8_bounded_join", "alarms tele",
    "SELECT a.logid, t.mo, t.factory AS tele_factory FROM alarms a LEFT JOIN tele t ON t.log_id = a.related_log_id AND t.time BETWEEN a.logdate - INTERVAL 10 MINUTE AND a.logdate + INTERVAL 10 MINUTE",
)
def _(t):
    right = t.tele.select(F.col("log_id").alias("related_log_id"), "time", "mo", F.col("factory").alias("tele_factory"))
    left = t.alarms.select("logid", "logdate", "related_log_id")
    return joins.bounded_join(left, right, ["related_log_id"], "logdate", "time", "10 minutes", "10 minutes").select("logid", "mo", "tele_factory")


@query("jn9_latest_per_key", "tele", "SELECT eqp_id, log_id, time, process FROM tele QUALIFY row_number() OVER (PARTITION BY eqp_id ORDER BY time DESC, log_id DESC) = 1")
def _(t):
    return joins.latest_per_key(t.tele.select("eqp_id", "log_id", "time", "process"), ["eqp_id"], "time", "log_id")


@query("jn10_distinct_on", "alarms", "SELECT DISTINCT ON (equipmentid, errorcode) equipmentid, errorcode, logid, logdate FROM alarms ORDER BY equipmentid, errorcode, logdate DESC, logid DESC")
def _(t):
    return joins.latest_per_key(t.alarms.select("equipmentid", "errorcode", "logid", "logdate"), ["equipmentid", "errorcode"], "logdate", "logid")


@query("jn11_semi", "devices alarms", "SELECT device_id, location FROM devices d WHERE EXISTS (SELECT 1 FROM alarms a WHERE a.equipmentid = d.device_id)")
def _(t):
    return joins.semi(t.devices.select("device_id", "location"), t.alarms.select(F.col("equipmentid").alias("device_id")), ["device_id"])


@query("jn12_orphans", "orders_lifecycle lifecycle alarms", "SELECT logid FROM (SELECT logid, logdate FROM orders_lifecycle UNION ALL SELECT logid, logdate FROM lifecycle) l WHERE NOT EXISTS (SELECT 1 FROM alarms a WHERE a.logid = l.logid AND a.logdate = l.logdate)")
def _(t):
    both = t.orders_lifecycle.select("logid", "logdate").unionByName(t.lifecycle.select("logid", "logdate"))
    return joins.orphans(both, t.alarms, ["logid", "logdate"]).select("logid")


@query("jn13_with_scalar", "tele", f"SELECT log_id, {r('temperature - (SELECT avg(temperature) FROM tele)', 4)} AS off FROM tele")
def _(t):
    base = t.tele.agg(F.avg("temperature").alias("base"))
    return joins.with_scalar(t.tele, base, ["base"]).select("log_id", fn.rnd(F.col("temperature") - F.col("base"), 4).alias("off"))


@query(
    "jn14_baseline_join", "sysm",
    f"SELECT b.device_id, {r('c.v - b.mu', 4)} AS off FROM (SELECT device_id, avg(cpu_load_percent) AS mu FROM sysm GROUP BY 1) b JOIN (SELECT device_id, avg(cpu_load_percent) AS v FROM sysm WHERE time > {_A} - INTERVAL 5 DAY GROUP BY 1) c USING (device_id)",
)
def _(t):
    base = t.sysm.groupBy("device_id").agg(F.avg("cpu_load_percent").alias("mu"))
    cur = fn.last(t.sysm, "time", "5 days", AS_OF).groupBy("device_id").agg(F.avg("cpu_load_percent").alias("v"))
    return base.join(cur, "device_id").select("device_id", fn.rnd(F.col("v") - F.col("mu"), 4).alias("off"))


@query("jn15_same_time_join", "tele alarms", "SELECT t.log_id, s.event_id FROM tele t JOIN (SELECT user_id, ts, event_id FROM events) s ON s.ts = t.time AND 'D' || CAST(s.user_id AS VARCHAR) = t.eqp_id")
def _(t):
    other = t.sysm.select("time", F.col("device_id").alias("eqp_id"), "event_id")
    return joins.join_dim(t.tele.select("time", "eqp_id", "log_id"), other, ["time", "eqp_id"]).select("log_id", "event_id")


@query(
    "jn16_join_on_device", "sysm netm",
    f"SELECT s.device_id, s.event_id, n.rx_mbps, n.iface_name FROM sysm s LEFT JOIN netm n ON n.device_id = s.device_id AND n.time > {_A} - INTERVAL 20 DAY WHERE s.time > {_A} - INTERVAL 20 DAY "
    "QUALIFY row_number() OVER (PARTITION BY s.device_id ORDER BY s.time DESC, s.event_id, n.rx_mbps DESC, n.event_id) <= 10",
)
def _(t):
    s, n = fn.last(t.sysm, "time", "20 days", AS_OF), fn.last(t.netm, "time", "20 days", AS_OF)
    out = joins.join_on_device(
        s.select("device_id", "time", "event_id"), n.select("device_id", "rx_mbps", "iface_name", F.col("event_id").alias("net_id")), "device_id",
        [F.desc("time"), F.asc("event_id")], [F.desc("rx_mbps"), F.asc("net_id")], 10,
    )
    return out.select("device_id", "event_id", "rx_mbps", "iface_name")


# ------------------------------------------------------------------------------------------ aggregates

@query("ag1_group_by", "tele", f"SELECT process, factory, count(*) AS n, {r('avg(temperature)', 4)} AS av, min(total_time) AS lo, max(total_time) AS hi, {r('sum(total_time)', 2)} AS total FROM tele GROUP BY 1, 2")
def _(t):
    return t.tele.groupBy("process", "factory").agg(
        F.count(F.lit(1)).alias("n"), fn.rnd(F.avg("temperature"), 4).alias("av"), F.min("total_time").alias("lo"), F.max("total_time").alias("hi"), fn.rnd(F.sum("total_time"), 2).alias("total")
    )


_WIDTHS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "1d": "1 day", "1w": "1 week"}


@query("ag2_time_bucket", "tele", " UNION ALL ".join(f"SELECT '{n}' AS width, time_bucket(INTERVAL '{w}', time) AS bucket, count(*) AS n FROM tele GROUP BY 2" for n, w in _WIDTHS.items()))
def _(t):
    # one scan: every row is tagged with its bucket of each width
    tags = F.explode(F.array(*[F.struct(F.lit(n).alias("width"), fn.time_bucket("time", w).alias("bucket")) for n, w in _WIDTHS.items()]))
    return t.tele.select(tags.alias("b")).groupBy("b.width", "b.bucket").agg(F.count(F.lit(1)).alias("n"))


@query("ag3_date_bin", "tele", "SELECT time_bucket(INTERVAL '7 minutes', time, TIMESTAMP '2000-01-01 00:03:00') AS bucket, count(*) AS n FROM tele GROUP BY 1")
def _(t):
    return t.tele.groupBy(fn.date_bin("7 minutes", "time", "2000-01-01 00:03:00").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("ag4_stddev", "tele", f"SELECT eqp_id, mo, layer_name, {r('stddev_samp(total_time)', 4)} AS sigma FROM tele GROUP BY 1, 2, 3")
def _(t):
    return t.tele.groupBy("eqp_id", "mo", "layer_name").agg(fn.rnd(F.stddev_samp("total_time"), 4).alias("sigma"))


@query("ag5_filtered_count", "tele", "SELECT eqp_id, count(*) FILTER (WHERE state) AS running, count(*) FILTER (WHERE temperature > 24) AS hot FROM tele GROUP BY 1")
def _(t):
    return t.tele.groupBy("eqp_id").agg(F.count_if("state").alias("running"), F.count_if(F.col("temperature") > 24).alias("hot"))


@query("ag6_count_distinct", "tele", "SELECT process, count(DISTINCT eqp_id) AS machines FROM tele GROUP BY 1")
def _(t):
    return t.tele.groupBy("process").agg(F.count_distinct("eqp_id").alias("machines"))


_DAYS = "(epoch_us(time) / 86400000000.0 - 19700)"


@query("ag7_regression", "tele", f"SELECT eqp_id, {r(f'regr_slope(total_time, {_DAYS})', 4)} AS slope, {r(f'regr_intercept(total_time, {_DAYS})', 2)} AS intercept, count(*) AS n FROM tele GROUP BY 1 HAVING count(*) > 2")
def _(t):
    out = agg.regression(t.tele, ["eqp_id"], F.col("total_time"), F.unix_micros("time") / F.lit(86400000000.0) - 19700).where(F.col("n") > 2)
    return out.select("eqp_id", fn.rnd("slope", 4).alias("slope"), fn.rnd("intercept", 2).alias("intercept"), "n")


@query("ag8_percentile", "tele", f"SELECT process, count(*) AS n, {r('quantile_cont(total_time, 0.5)', 4)} AS p50, {r('quantile_cont(total_time, 0.95)', 4)} AS p95, {r('quantile_cont(total_time, 0.99)', 4)} AS p99 FROM tele GROUP BY 1")
def _(t):
    out = agg.exact_percentiles(t.tele, ["process"], "total_time", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return out.withColumns({p: fn.rnd(p, 4) for p in ("p50", "p95", "p99")})


@query("ag9_first_by", "alarms catalog", "SELECT a.equipmentid, first(a.errorcode ORDER BY CASE c.severity WHEN 'Critical' THEN 0 WHEN 'Major' THEN 1 ELSE 2 END, a.logdate DESC) AS top_code FROM alarms a JOIN catalog c ON c.alarm_code = a.errorcode GROUP BY 1")
def _(t):
    rank = F.when(F.col("severity") == "Critical", 0).when(F.col("severity") == "Major", 1).otherwise(2)
    joined = t.alarms.join(t.catalog.select(F.col("alarm_code").alias("errorcode"), "severity"), "errorcode")
    return joined.groupBy("equipmentid").agg(agg.first_by("errorcode", [rank, -F.unix_micros("logdate")]).alias("top_code"))


@query("ag10_conditional_vote", "netm", "SELECT device_id, iface_name FROM netm GROUP BY 1, 2 HAVING sum(CASE WHEN status = 'DOWN' THEN 1 ELSE 0 END) > sum(CASE WHEN status = 'UP' THEN 1 ELSE 0 END)")
def _(t):
    return infra.interface_down(t.netm, AS_OF, "60 days").select("device_id", "iface_name")


@query("ag12_global", "tele", f"SELECT count(*) AS n, {r('avg(temperature)', 4)} AS av, {r('100.0 * count(*) FILTER (WHERE state) / count(*)', 2)} AS up_pct FROM tele")
def _(t):
    return t.tele.agg(F.count(F.lit(1)).alias("n"), fn.rnd(F.avg("temperature"), 4).alias("av"), fn.rnd(F.count_if("state") * 100.0 / F.count(F.lit(1)), 2).alias("up_pct"))


@query("ag13_duplicate_report", "", "SELECT count(*) AS total_rows, count(DISTINCT (l_suppkey, l_shipdate)) AS distinct_keys, count(*) - count(DISTINCT (l_suppkey, l_shipdate)) AS duplicates FROM lineitem")
def _(t):
    return agg.duplicate_report(t.raw("lineitem"), ["l_suppkey", "l_shipdate"])


# ------------------------------------------------------------------------------------------ windows

_SER = f"WITH s AS (SELECT time, eqp_id, log_id, {_ABS_PE0} AS x FROM tele WHERE pe_1 IS NOT NULL) "
_W = "PARTITION BY eqp_id ORDER BY time, log_id"


@query("wn1_rolling_stats", "tele", _SER + f"SELECT log_id, {r(f'avg(x) OVER w', 4)} AS mu, {r('stddev_samp(x) OVER w', 3)} AS sigma FROM s WINDOW w AS ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def _(t, max_rows=None):
    out = control.rolling_stats(control.error_series(t.tele), "raw_value", 30, max_rows)
    return out.select("log_id", fn.rnd("mu", 4).alias("mu"), fn.rnd("sigma", 3).alias("sigma"))


@query("wn1_rolling_stats_split", same_as="wn1_rolling_stats")
def _(t):
    out = control.rolling_stats(control.error_series(t.tele), "raw_value", 30, TINY)
    return out.select("log_id", fn.rnd("mu", 4).alias("mu"), fn.rnd("sigma", 3).alias("sigma"))


@query("wn2_expanding_stats", "tele", _SER + f"SELECT log_id, {r('avg(x) OVER w', 4)} AS mu, {r('stddev_samp(x) OVER w', 3)} AS sigma FROM s WINDOW w AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(t):
    return control.expanding(control.error_series(t.tele), "raw_value").select("log_id", fn.rnd("mu", 4).alias("mu"), fn.rnd("sigma", 3).alias("sigma"))


@query("wn2_expanding_stats_split", same_as="wn2_expanding_stats")
def _(t):
    return control.expanding(control.error_series(t.tele), "raw_value", 16).select("log_id", fn.rnd("mu", 4).alias("mu"), fn.rnd("sigma", 3).alias("sigma"))


_STEP = "CASE WHEN state THEN 1 ELSE -1 END"


@query("wn3_running_signs", "tele", f"SELECT log_id, CAST(sum({_STEP}) OVER ({_W} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS BIGINT) AS s9, CAST(sum({_STEP}) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT) AS s6 FROM tele")
def _(t):
    step = F.when(F.col("state"), 1).otherwise(-1)

    def build(df, w):
        return df.withColumns({"s9": F.sum(step).over(w.rowsBetween(-8, 0)), "s6": F.sum(step).over(w.rowsBetween(-5, 0))})

    return series.over_rows(t.tele.select("time", "eqp_id", "log_id", "state"), ["eqp_id"], ["time", "log_id"], 8, build).select("log_id", "s9", "s6")


@query("wn4_lag_delta", "tele", f"SELECT log_id, {r(f'total_time - lag(total_time) OVER ({_W})', 4)} AS delta FROM tele")
def _(t):
    def build(df, w):
        return df.withColumn("delta", fn.rnd(F.col("total_time") - F.lag("total_time").over(w), 4))

    return series.over_rows(t.tele.select("time", "eqp_id", "log_id", "total_time"), ["eqp_id"], ["time", "log_id"], 1, build, TINY).select("log_id", "delta")


@query("wn5_state_transitions", "tele", f"WITH s AS (SELECT log_id, state, lag(state) OVER ({_W}) AS was FROM tele) SELECT log_id, CASE WHEN state THEN 'Machine Start' ELSE 'Machine Stop' END AS event_type FROM s WHERE state <> was")
def _(t):
    def build(df, w):
        return df.withColumn("was", F.lag("state").over(w))

    out = series.over_rows(t.tele.select("time", "eqp_id", "log_id", "state"), ["eqp_id"], ["time", "log_id"], 1, build)
    return out.where(F.col("state") != F.col("was")).select("log_id", F.when(F.col("state"), "Machine Start").otherwise("Machine Stop").alias("event_type"))


@query("wn6_row_number", "tele", f"SELECT log_id, CAST(row_number() OVER ({_W}) AS INTEGER) AS row_no FROM tele")
def _(t):
    return series.row_positions(t.tele.select("time", "eqp_id", "log_id"), ["eqp_id"], ["time", "log_id"]).select("log_id", "row_no")


@query("wn6_row_number_split", same_as="wn6_row_number")
def _(t):
    return series.row_positions(t.tele.select("time", "eqp_id", "log_id"), ["eqp_id"], ["time", "log_id"], "5 days").select("log_id", "row_no")


@query("wn7_alarm_gaps", "alarms", "SELECT logid, epoch_us(logdate) - lag(epoch_us(logdate)) OVER (PARTITION BY equipmentid, errorcode ORDER BY logdate, logid) AS gap_us FROM alarms")
def _(t):
    from ..operators.alarms import alarm_gaps

    return alarm_gaps(t.alarms).select("logid", "gap_us")


_RATE = "CASE WHEN status = 1 AND (prx > 0 OR ptx > 0) AND dt > 0.5 AND {m} <= 40000 THEN " + r("least({m}, 80000)", 2) + " ELSE 0 END"


def _mbps(d: str) -> str:
    return f"(CAST(CASE WHEN {d} < p{d} THEN {d} - p{d} + 18446744073709551616 ELSE {d} - p{d} END AS DOUBLE) * 8 / (dt * 1e6))"


@query(
    "wn8_counter_rate", "counters",
    "WITH polls AS (SELECT device_id, ts, lag(ts) OVER (PARTITION BY device_id ORDER BY ts) AS before FROM (SELECT DISTINCT device_id, ts FROM counters)), "
    "c AS (SELECT *, CAST(CASE WHEN rx64 > 0 THEN rx64 ELSE rx32 END AS DECIMAL(38,0)) AS rx, CAST(CASE WHEN tx64 > 0 THEN tx64 ELSE tx32 END AS DECIMAL(38,0)) AS tx FROM counters), "
    "p AS (SELECT c.device_id, c.name AS iface_name, c.ts, c.status, c.rx, c.tx, old.rx AS prx, old.tx AS ptx, (epoch_us(c.ts) - epoch_us(polls.before)) / 1000000.0 AS dt "
    "FROM c JOIN polls ON polls.device_id = c.device_id AND polls.ts = c.ts LEFT JOIN c old ON old.device_id = c.device_id AND old.iface = c.iface AND old.ts = polls.before WHERE c.name <> '') "
    f"SELECT device_id, iface_name, ts, {_RATE.format(m=_mbps('rx'))} AS rx_mbps, {_RATE.format(m=_mbps('tx'))} AS tx_mbps, CAST(NULL AS BIGINT) AS errors, CAST(NULL AS BIGINT) AS drops, CASE WHEN status = 1 THEN 'UP' ELSE 'DOWN' END AS status FROM p",
)
def _(t):
    return infra.counter_rate(t.counters)


# ------------------------------------------------------------------------------------------ top-k, sets

@query("tk1_nulls_last", "tele", f"SELECT log_id, {r('pe_6', 4)} AS pe_6 FROM tele ORDER BY pe_6 DESC NULLS LAST, log_id LIMIT 500")
def _(t):
    return agg.top_k(t.tele.select("log_id", "pe_6"), [F.desc_nulls_last("pe_6"), F.asc("log_id")], 500).withColumn("pe_6", fn.rnd("pe_6", 4))


@query("tk2_latest_alarms", "alarms", "SELECT logid, logdate, equipmentid, errorcode FROM alarms ORDER BY logdate DESC, logid LIMIT 50")
def _(t):
    return agg.top_k(t.alarms.select("logid", "logdate", "equipmentid", "errorcode"), [F.desc("logdate"), F.asc("logid")], 50)


@query("tk3_severity_rank", "alarms catalog", "SELECT a.logid, c.severity, a.logdate FROM alarms a JOIN catalog c ON c.alarm_code = a.errorcode ORDER BY CASE c.severity WHEN 'Critical' THEN 0 WHEN 'Major' THEN 1 WHEN 'NONE' THEN 2 ELSE 3 END, a.logdate DESC, a.logid LIMIT 50")
def _(t):
    from ..operators.alarms import severity_rank

    rows = t.alarms.join(t.catalog.select(F.col("alarm_code").alias("errorcode"), "severity"), "errorcode").select("logid", "severity", "logdate")
    return agg.top_k(rows, [severity_rank(), F.desc("logdate"), F.asc("logid")], 50)


@query("tk4_longest_waiting", "lifecycle", "SELECT logid, logdate FROM lifecycle WHERE status = 'OPEN' ORDER BY logdate, logid LIMIT 20")
def _(t):
    return agg.top_k(t.lifecycle.where("status = 'OPEN'").select("logid", "logdate"), [F.asc("logdate"), F.asc("logid")], 20)


@query("tk5_repeat_offenders", "alarms", "SELECT equipmentid, errorcode, count(*) AS n FROM alarms GROUP BY 1, 2 ORDER BY n DESC, equipmentid, errorcode LIMIT 5")
def _(t):
    return agg.top_k(t.alarms.groupBy("equipmentid", "errorcode").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.asc("equipmentid"), F.asc("errorcode")], 5)


@query("st1_union_events", "tele alarms", "SELECT time AS event_time, eqp_id, 'tele' AS source FROM tele UNION ALL SELECT logdate, equipmentid, 'alarm' FROM alarms")
def _(t):
    return agg.union_events(
        t.tele.select(F.col("time").alias("event_time"), "eqp_id", F.lit("tele").alias("source")), t.alarms.select(F.col("logdate").alias("event_time"), F.col("equipmentid").alias("eqp_id"), F.lit("alarm").alias("source"))
    )


@query("st2_category_counts", "alarms", f"WITH c(category) AS (VALUES ('VACUUM'), ('MOTION'), ('SAFETY')), a AS (SELECT {CATEGORY_SQL.format(c='errorcode')} AS category FROM alarms) SELECT c.category, count(a.category) AS n FROM c LEFT JOIN a USING (category) GROUP BY 1")
def _(t):
    from ..operators.rca import category_column

    counted = t.alarms.groupBy(category_column(F.col("errorcode")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    names = t.spark.createDataFrame([("VACUUM",), ("MOTION",), ("SAFETY",)], "category string")
    return names.join(counted, "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("st3_fallback_row", "alarms", "WITH v AS (SELECT logid FROM alarms WHERE equipmentid = 'nobody') SELECT * FROM v UNION ALL SELECT 'NONE' WHERE NOT EXISTS (SELECT 1 FROM v)")
def _(t):
    none = t.spark.range(1).select(F.lit("NONE").alias("logid"))
    return agg.with_fallback_row(t.alarms.where("equipmentid = 'nobody'").select("logid"), none)


@query("st4_distinct_values", "tele", "SELECT DISTINCT eqp_id AS value FROM tele WHERE factory IN ('1') AND mo IN ('MO1', 'MO2')")
def _(t):
    return agg.distinct_values(t.tele, "eqp_id", fn.in_or_all("factory", ["1"]) & fn.in_or_all("mo", ["MO1", "MO2"]))
