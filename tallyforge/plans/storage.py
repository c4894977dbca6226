"""Ingestion, sinks and table maintenance: written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import rollup
from ..schema import JE_COLS, PE_COLS
from ..session import scratch_path
from ..sources import ingest, maintenance, varbinds
from .registry import query, r
from .tables import AS_OF, Tables

_A = f"TIMESTAMP '{AS_OF}'"

# ------------------------------------------------------------------------------------------ sources

_J = ["eqp_id", "factory", "process", "mo", "fpn", "layer_name", "temperature", "humidity", "air_vacuum", *PE_COLS, *JE_COLS, "pe_setting", "board_no", "total_board", "state", "log_id", "time"]


def telemetry_json(t: Tables) -> DataFrame:
    """Telemetry as the producers send it; machines whose id ends in 7 have lost it, one reading is not a number."""
    rows = t.tele.select(*_J).withColumns(
        {
            "eqp_id": F.when(F.col("eqp_id").endswith("7"), "").otherwise(F.col("eqp_id")),
            "humidity": F.when(F.col("process") == "click", "n/a").otherwise(F.col("humidity").cast("string")),
            "state": F.when(F.col("mo") == "MO1", F.lit(None)).otherwise(F.col("state")),
            "time": F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        }
    )
    return rows.select(F.to_json(F.struct(*_J)).alias("value"))


_INGESTED = (
    "SELECT eqp_id, process, mo, log_id, time, " + f"{r('temperature', 4)} AS temperature, CASE WHEN process = 'click' THEN NULL ELSE {r('humidity', 4)} END AS humidity, {r('air_vacuum', 4)} AS air_vacuum, {r('pe_6', 4)} AS pe_6, "
    "CAST(board_no AS INTEGER) AS board_no, CASE WHEN mo = 'MO1' THEN true ELSE state END AS state, '' AS filmno FROM tele WHERE NOT ends_with(eqp_id, '7')"
)


def _ingested(df: DataFrame) -> DataFrame:
    return df.select(
        "eqp_id", "process", "mo", "log_id", "time", *[fn.rnd(c, 4).alias(c) for c in ("temperature", "humidity", "air_vacuum", "pe_6")], "board_no", "state", "filmno"
    )


@query("src1_ingest_telemetry", "tele", _INGESTED)
def _(t: Tables) -> DataFrame:
    return _ingested(ingest.ingest_telemetry(telemetry_json(t)))


# walks made of events: each is one reading whose walker and object depend on it
_OID = (
    "CASE event_type WHEN 'click' THEN '1.3.6.1.2.1.25.3.3.1.2.' || CAST(k % 4 AS {s}) WHEN 'view' THEN '1,3,6,1,4,1,2636,3,1,13,1,7,' || CAST(k % 3 AS {s}) "
    "WHEN 'signup' THEN CASE k % 3 WHEN 0 THEN '1.3.6.1.4.1.9999.1.1.0' WHEN 1 THEN '1.3.6.1.4.1.9999.1.2.0' ELSE '1.3.6.1.4.1.9999.1.4.2' END ELSE '1.3.6.1.2.1.2.2.1.' || CAST(k % 20 AS {s}) || '.' || CAST(k % 2 AS {s}) END"
)
_WALKER = "CASE event_type WHEN 'click' THEN 'cpu' WHEN 'view' THEN 'temp' WHEN 'signup' THEN 'ldi' ELSE 'net' END"
_VARBINDS = f"vb AS (SELECT 'D' || CAST(user_id AS VARCHAR) AS device_id, date_trunc('day', ts) AS ts, {_WALKER} AS walker, replace({_OID.format(s='VARCHAR')}, ',', '.') AS oid, CAST(floor(value) AS INTEGER) AS v, event_id FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"


def walks(t: Tables) -> DataFrame:
    ev = t.raw("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return ev.selectExpr("'D' || CAST(user_id AS STRING) AS device_id", "date_trunc('day', ts) AS ts", f"{_WALKER} AS walker", f"{_OID.format(s='STRING')} AS oid", "CAST(CAST(floor(value) AS INT) AS STRING) AS value", "event_id")


@query("src2_cpu_walk", "", f"WITH {_VARBINDS} SELECT device_id, ts, CAST(count(*) AS INTEGER) AS cpu_cores, greatest(0, least(100, {r('avg(v)', 2)})) AS cpu_load_percent, count(DISTINCT oid) AS cores FROM vb WHERE walker = 'cpu' GROUP BY 1, 2")
def _(t):
    return varbinds.cpu_metrics(walks(t)).select("device_id", "ts", "cpu_cores", "cpu_load_percent", F.size("cpu_metrics").cast("long").alias("cores"))


@query("src2_temp_walk", "", f"WITH {_VARBINDS} SELECT device_id, ts, CAST(greatest(-40, least(150, max(v))) AS DOUBLE) AS temp_c, count(DISTINCT CASE WHEN v > 0 THEN oid END) AS sensors FROM vb WHERE walker = 'temp' GROUP BY 1, 2")
def _(t):
    return varbinds.temp_metrics(walks(t)).select("device_id", "ts", "temp_c", F.size("temp_metrics").cast("long").alias("sensors"))


@query(
    "src2_machine_walk", "",
    f"WITH {_VARBINDS} SELECT device_id, ts, CAST(max(v) FILTER (WHERE oid = '1.3.6.1.4.1.9999.1.1.0') AS DOUBLE) AS throughput, {r('max(v) FILTER (WHERE oid = ' + chr(39) + '1.3.6.1.4.1.9999.1.2.0' + chr(39) + ') / 100.0', 2)} AS temperature, "
    f"{r('avg(v) FILTER (WHERE oid = ' + chr(39) + '1.3.6.1.4.1.9999.1.4.2' + chr(39) + ') / 100.0', 4)} AS pe FROM vb WHERE walker = 'ldi' GROUP BY 1, 2",
)
def _(t):
    return varbinds.machine_metrics(walks(t)).select("device_id", "ts", "throughput", "temperature", fn.rnd("pe", 4).alias("pe"))


@query(
    "src2_net_walk", "",
    f"WITH {_VARBINDS}, n AS (SELECT *, split_part(oid, '.', 10) AS p, split_part(oid, '.', 11) AS iface FROM vb WHERE walker = 'net') SELECT device_id, ts, iface, coalesce(max(v) FILTER (WHERE p = '10'), 0) AS rx32, coalesce(max(v) FILTER (WHERE p = '16'), 0) AS tx32, "
    "CAST(coalesce(sum(v) FILTER (WHERE p = '13'), 0) AS BIGINT) AS drops, CAST(coalesce(sum(v) FILTER (WHERE p = '14'), 0) AS BIGINT) AS errors, coalesce(max(v) FILTER (WHERE p = '8'), 1) AS status, coalesce(max(CAST(v AS VARCHAR)) FILTER (WHERE p = '2'), '') AS name FROM n GROUP BY 1, 2, 3",
)
def _(t):
    return varbinds.interface_counters(walks(t)).select("device_id", "ts", "iface", *[F.col(c).cast("int").alias(c) for c in ("rx32", "tx32")], "drops", "errors", "status", "name")


# storage rows: allocation unit, size and use of four entries per device and day
_STORE = (
    "st AS (SELECT 'D' || CAST(user_id AS VARCHAR) AS device_id, date_trunc('day', ts) AS ts, CAST(1 + k % 4 AS INTEGER) AS idx, max(value) AS val, max(k) AS k FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) GROUP BY 1, 2, 3), "
    "e AS (SELECT *, CASE idx WHEN 1 THEN '1.3.6.1.2.1.25.2.1.2' WHEN 2 THEN '1.3.6.1.2.1.25.2.1.4' ELSE '' END AS kind, CAST(4096 AS DOUBLE) * (1000000 + CAST(floor(val) AS BIGINT) * 10000) AS total, CAST(4096 AS DOUBLE) * (1000 * k) AS used FROM st)"
)


def _storage_walks(t: Tables) -> DataFrame:
    ev = t.raw("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    st = ev.groupBy(F.concat(F.lit("D"), F.col("user_id").cast("string")).alias("device_id"), F.date_trunc("day", "ts").alias("ts"), (1 + F.col("k") % 4).alias("idx")).agg(F.max("value").alias("val"), F.max("k").alias("k"))
    kind = F.when(F.col("idx") == 1, "1.3.6.1.2.1.25.2.1.2").when(F.col("idx") == 2, "1.3.6.1.2.1.25.2.1.4").otherwise("")
    fields = {"2": kind, "4": F.lit("4096"), "5": (1000000 + F.floor("val") * 10000).cast("string"), "6": (1000 * F.col("k")).cast("string")}
    rows = F.explode(F.array(*[F.struct(F.concat_ws(".", F.lit(varbinds.STORAGE_OID + p), F.col("idx").cast("string")).alias("oid"), v.alias("value")) for p, v in fields.items()]))
    return st.select("device_id", "ts", F.lit("storage").alias("walker"), rows.alias("r")).select("device_id", "ts", "walker", "r.oid", "r.value")


_RAM = "(kind <> '' AND idx = 1)"


@query(
    "src2_storage_walk", "",
    f"WITH {_STORE}, g AS (SELECT *, {_RAM} AS named, total > 100000000 AND total < 8000000000 AS sized FROM e), f AS (SELECT device_id, ts, min(idx) FILTER (WHERE named OR sized) AS first_ram FROM g GROUP BY 1, 2), "
    "h AS (SELECT g.*, named OR (sized AND idx = first_ram) AS ram FROM g JOIN f USING (device_id, ts)), ld AS (SELECT device_id, ts, max(idx) FILTER (WHERE NOT ram AND kind LIKE '%25.2.1.4') AS last_disk FROM h GROUP BY 1, 2), "
    "p AS (SELECT h.device_id, h.ts, max_by(struct_pack(t := total, u := used), idx) FILTER (WHERE ram) AS r, max_by(struct_pack(t := total, u := used), (total, idx)) FILTER (WHERE NOT ram AND (last_disk IS NULL OR idx >= last_disk)) AS d FROM h JOIN ld USING (device_id, ts) GROUP BY 1, 2) "
    f"SELECT device_id, ts, {r('coalesce(r.t / 1048576, 1)', 2)} AS ram_total_mb, {r('least(coalesce(r.u / 1048576, 0), coalesce(r.t / 1048576, 1))', 2)} AS ram_used_mb, {r('coalesce(d.t / 1073741824, 1)', 2)} AS disk_total_gb, {r('least(coalesce(d.u / 1073741824, 0), coalesce(d.t / 1073741824, 1))', 2)} AS disk_used_gb FROM p",
)
def _(t):
    return varbinds.storage_metrics(_storage_walks(t)).select("device_id", "ts", "ram_total_mb", "ram_used_mb", "disk_total_gb", "disk_used_gb")


# everything that walks have told of a device so far, after each of its walks
_STATE = (
    f"WITH RECURSIVE {_VARBINDS}, {_STORE}, g AS (SELECT *, {_RAM} AS named, total > 100000000 AND total < 8000000000 AS sized FROM e), f AS (SELECT device_id, ts, min(idx) FILTER (WHERE named OR sized) AS first_ram FROM g GROUP BY 1, 2), "
    "h AS (SELECT g.*, named OR (sized AND idx = first_ram) AS ram FROM g JOIN f USING (device_id, ts)), ld AS (SELECT device_id, ts, max(idx) FILTER (WHERE NOT ram AND kind LIKE '%25.2.1.4') AS last_disk FROM h GROUP BY 1, 2), "
    "p AS (SELECT h.device_id, h.ts, max_by(struct_pack(t := total, u := used), idx) FILTER (WHERE ram) AS r, max_by(struct_pack(t := total, u := used), (total, idx)) FILTER (WHERE NOT ram AND (last_disk IS NULL OR idx >= last_disk)) AS d FROM h JOIN ld USING (device_id, ts) GROUP BY 1, 2), "
    f"w AS (SELECT device_id, ts, walker, {r("avg(v) FILTER (WHERE walker = 'cpu')", 2)} AS cpu, max(v) FILTER (WHERE walker = 'temp' AND v > 0) AS temp, CAST(NULL AS DOUBLE) AS rt, CAST(NULL AS DOUBLE) AS ru, CAST(NULL AS DOUBLE) AS dt, CAST(NULL AS DOUBLE) AS du, max(v) FILTER (WHERE oid = '1.3.6.1.4.1.9999.1.4.2') / 100.0 AS pe FROM vb GROUP BY 1, 2, 3 "
    "UNION ALL SELECT device_id, ts, 'storage', NULL, NULL, r.t, r.u, d.t, d.u, NULL FROM p), "
    "q AS (SELECT device_id, ts, pe, row_number() OVER (PARTITION BY device_id ORDER BY ts) AS rn FROM w WHERE pe IS NOT NULL), z AS (SELECT device_id, ts, rn, pe AS z FROM q WHERE rn = 1 UNION ALL SELECT q.device_id, q.ts, q.rn, CASE WHEN z.z = 0 THEN q.pe ELSE (z.z + q.pe) / 2 END FROM z JOIN q ON q.device_id = z.device_id AND q.rn = z.rn + 1), "
    "n AS (SELECT w.device_id, w.ts, walker, last(cpu IGNORE NULLS) OVER o AS cpu, max(temp) OVER o AS temp, last(rt IGNORE NULLS) OVER o AS rt, last(ru IGNORE NULLS) OVER o AS ru, last(dt IGNORE NULLS) OVER o AS dt, last(du IGNORE NULLS) OVER o AS du, max(CASE WHEN walker = 'storage' THEN 1 END) OVER o AS stored, last(z.z IGNORE NULLS) OVER o AS pe "
    "FROM w LEFT JOIN z ON w.walker = 'ldi' AND z.device_id = w.device_id AND z.ts = w.ts WINDOW o AS (PARTITION BY w.device_id ORDER BY w.ts, walker ROWS UNBOUNDED PRECEDING)) "
    f"SELECT device_id, ts, walker, greatest(0, least(100, coalesce(cpu, 0))) AS cpu_load_percent, CAST(greatest(-40, least(150, coalesce(temp, 0))) AS DOUBLE) AS temp_c, {r('CASE WHEN stored = 1 THEN coalesce(rt / 1048576, 1) ELSE 0 END', 2)} AS ram_total_mb, "
    f"{r('CASE WHEN stored = 1 THEN least(coalesce(ru / 1048576, 0), coalesce(rt / 1048576, 1)) ELSE 0 END', 2)} AS ram_used_mb, {r('CASE WHEN stored = 1 THEN coalesce(dt / 1073741824, 1) ELSE 0 END', 2)} AS disk_total_gb, "
    f"{r('CASE WHEN stored = 1 THEN least(coalesce(du / 1073741824, 0), coalesce(dt / 1073741824, 1)) ELSE 0 END', 2)} AS disk_used_gb, {r('coalesce(pe, 0)', 4)} AS pe FROM n"
)


def all_walks(t: Tables) -> DataFrame:
    return walks(t).drop("event_id").unionByName(_storage_walks(t))


def shown_walks(df: DataFrame) -> DataFrame:
    return df.select("device_id", "ts", "walker", "cpu_load_percent", "temp_c", "ram_total_mb", "ram_used_mb", "disk_total_gb", "disk_used_gb", fn.rnd("pe", 4).alias("pe"))


@query("src2_device_state", "", _STATE)
def _(t):
    return shown_walks(varbinds.device_state(all_walks(t)))


@query("src2_device_state_split", same_as="src2_device_state")
def _(t):
    return shown_walks(varbinds.device_state(all_walks(t), max_rows=9))


@query("src3_normalize_oid", "", f"WITH {_VARBINDS} SELECT event_id, oid FROM vb")
def _(t):
    return walks(t).select("event_id", fn.normalize_oid("oid").alias("oid"))


_ACTION = "CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'die' WHEN 'signup' THEN 'exec_start' WHEN 'purchase' THEN 'oom' ELSE 'restart' END"


@query("src4_container_events", "", f"SELECT 'c' || CAST(user_id AS VARCHAR) AS container_name, {_ACTION} AS event_action, date_trunc('second', ts) AS event_time, length(CAST(event_id AS VARCHAR)) AS id_len FROM events WHERE event_type <> 'signup' AND user_id % 10 <> 3")
def _(t):
    ev = t.raw("events")
    name = F.when(F.col("user_id") % 10 != 3, F.concat(F.lit("c"), F.col("user_id").cast("string")))
    actor = F.struct(F.struct(name.alias("name")).alias("Attributes"))
    lines = ev.select(F.to_json(F.struct(F.expr(_ACTION).alias("Action"), F.unix_seconds("ts").alias("time"), actor.alias("Actor"), F.col("event_id").cast("string").alias("id"))).alias("value"))
    out = ingest.ingest_container_events(lines)
    return out.select("container_name", "event_action", "event_time", F.length(F.get_json_object("raw_event", "$.id")).cast("long").alias("id_len"))


@query("src5_append_idempotent", "alarms", f"SELECT logid, logdate FROM alarms WHERE logdate > {_A} - INTERVAL 15 DAY")
def _(t):
    # the second half of the log arrives twice, together with rows that are stored already
    stored = t.alarms.where(F.col("logdate") <= fn.ts_lit(fn.minus(AS_OF, "15 days")))
    arriving = t.alarms.unionByName(t.alarms)
    return ingest.append_idempotent(arriving, stored, ["logdate", "logid"]).select("logid", "logdate")


@query("src6_append_telemetry", "tele", "SELECT count(*) AS n, count(DISTINCT log_id) AS ids FROM tele WHERE process <> 'view'")
def _(t):
    stored = t.tele.where("process = 'view'")
    out = ingest.append_idempotent(t.tele.unionByName(t.tele), stored, ["log_id", "time"])
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("log_id").alias("ids"))


@query("src7_bulk_replace", "tele", "SELECT 'telemetry' AS table_name, count(*) AS row_count FROM tele")
def _(t):
    path = scratch_path(t.spark, "bulk")
    maintenance.bulk_replace(t.alarms, path, "alarms")
    return maintenance.bulk_replace(t.tele, path, "telemetry")


@query("src8_catalog_upsert", "", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'new' ELSE p_type END AS p_type, CAST(CASE WHEN p_size > 25 THEN p_size + 1 ELSE p_size END AS INTEGER) AS p_size FROM part UNION ALL SELECT p_partkey + 1000000, 'added', 0 FROM part WHERE p_size > 40")
def _(t):
    base = t.raw("part").select("p_partkey", "p_type", "p_size")
    delta = base.where("p_size > 25").select("p_partkey", F.lit("new").alias("p_type"), (F.col("p_size") + 1).alias("p_size"))
    added = base.where("p_size > 40").select((F.col("p_partkey") + 1000000).alias("p_partkey"), F.lit("added").alias("p_type"), F.lit(0).alias("p_size"))
    return ingest.upsert(base, delta.unionByName(added), ["p_partkey"])


@query("src9_patch_column", "catalog", "SELECT alarm_id, CASE alarm_id WHEN '90005' THEN 'registration error' WHEN '90001' THEN 'alignment error' ELSE alarm_detail END AS alarm_detail FROM catalog")
def _(t):
    return ingest.patch_column(t.catalog.select("alarm_id", "alarm_detail"), "alarm_id", "alarm_detail", {"90005": "registration error", "90001": "alignment error", "nothing": "x"})


@query("src10_normalize_sentinels", "", "SELECT event_id, NULLIF(k % 5, 0) AS vacuum, NULLIF(CASE WHEN k % 2 = 0 THEN '' ELSE event_type END, '') AS resist FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)")
def _(t):
    ev = t.raw("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    raw = ev.select("event_id", (F.col("k") % 5).alias("vacuum"), F.when(F.col("k") % 2 == 0, "").otherwise(F.col("event_type")).alias("resist"))
    return ingest.normalize_sentinels(raw, ["vacuum"], ["resist"])


@query("src10_metric_maps", "sysm", f"SELECT event_id, {r('cpu_load_percent', 4)} AS cpu_avg, {r('temp_c', 4)} AS sensor_1 FROM sysm")
def _(t):
    blank = t.sysm.select("event_id", "cpu_load_percent", "temp_c", F.expr("CAST(map() AS map<string,double>)").alias("cpu_metrics"), F.expr("CAST(NULL AS map<string,double>)").alias("temp_metrics"))
    return ingest.backfill_metric_maps(blank).select("event_id", fn.rnd(F.col("cpu_metrics")["avg"], 4).alias("cpu_avg"), fn.rnd(F.col("temp_metrics")["sensor_1"], 4).alias("sensor_1"))


# ------------------------------------------------------------------------------------------ sinks and maintenance

@query(
    "snk1_staging_ledger", "tele",
    "SELECT process AS target_table, CASE WHEN process = 'purchase' THEN 'failed' ELSE 'committed' END AS status, CAST(CASE WHEN process IN ('purchase', 'signup') THEN 2 ELSE 1 END AS INTEGER) AS attempts, "
    "count(*) AS row_count, CASE WHEN process = 'purchase' THEN 0 ELSE count(*) END AS stored FROM tele GROUP BY process",
)
def _(t):
    root = scratch_path(t.spark, "staging")
    ledger, table = f"{root}/ledger", maintenance.batch_sink(f"{root}/table")

    def refuse(df: DataFrame, batch_id: int) -> None:
        raise OSError("target not reachable")

    def half_way(df: DataFrame, batch_id: int) -> None:
        table(df, batch_id)
        raise OSError("connection lost after the write")

    def mended(df: DataFrame, batch_id: int) -> None:
        (refuse if batch_id == 2 else table)(df, batch_id)

    for i, (kind, sink) in enumerate((("view", table), ("click", table), ("purchase", refuse), ("signup", half_way))):
        batch = t.tele.where(F.col("process") == kind).select("log_id", "eqp_id", "time", "temperature", "process")
        maintenance.stage_batch(batch, i, kind, ledger, f"{root}/payload", "time", sink)
    # the second try reaches the table for one of the two; what it had written before must not count twice
    maintenance.replay(t.spark, ledger, f"{root}/payload", "time", mended)
    state = maintenance.ledger_state(t.spark.read.schema(maintenance.LEDGER).parquet(ledger))
    stored = t.spark.read.parquet(f"{root}/table").groupBy(F.col("process").alias("target_table")).agg(F.count(F.lit(1)).alias("stored"))
    return state.join(stored, "target_table", "left").select("target_table", "status", "attempts", "row_count", F.coalesce("stored", F.lit(0)).alias("stored"))


@query("snk2_stamp_ingest", "tele", "SELECT log_id, true AS stamped FROM tele")
def _(t):
    return ingest.stamp_ingest(t.tele.drop("ingest_ts")).select("log_id", (F.col("ingest_ts") > F.col("time")).alias("stamped"))


@query("mnt1_partitioned_layout", "tele", "SELECT CAST(time AS DATE) AS date, CAST(hour(time) AS INTEGER) AS hour, count(*) AS n FROM tele GROUP BY 1, 2")
def _(t):
    path = scratch_path(t.spark, "layout")
    maintenance.write_partitioned(t.tele.select("time", "eqp_id", "log_id"), path, "time", "1 day")
    return t.spark.read.parquet(path).groupBy("date", F.hour("time").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("mnt2_compact", "tele", f"SELECT eqp_id, count(*) AS n, max(time) AS newest, {r('avg(temperature)', 4)} AS avg_temp FROM tele GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "compact")
    maintenance.compact(t.tele.select("eqp_id", "time", "temperature"), ["eqp_id"], [F.desc("time")], 8).write.parquet(path)
    return t.spark.read.parquet(path).groupBy("eqp_id").agg(F.count(F.lit(1)).alias("n"), F.max("time").alias("newest"), fn.rnd(F.avg("temperature"), 4).alias("avg_temp"))


@query("mnt3_retention", "tele", f"SELECT log_id FROM tele WHERE time >= {_A} - INTERVAL 14 DAY")
def _(t):
    path, keep = scratch_path(t.spark, "retained"), maintenance.RETENTION["sys"]
    maintenance.write_partitioned(t.tele.select("time", "eqp_id", "log_id"), path, "time", "1 day")
    maintenance.drop_expired(t.spark, path, keep, AS_OF)
    # whole days are gone from the disk; the day that the bound cuts is filtered
    return maintenance.apply_retention(t.spark.read.parquet(path), "time", keep, AS_OF).select("log_id")


@query("mnt5_snapshot", "tele", "SELECT process, count(*) AS n FROM tele GROUP BY 1")
def _(t):
    root = scratch_path(t.spark, "snapshots")
    maintenance.refresh_snapshot(t.spark, root, lambda: t.tele.where("process = 'view'").groupBy("process").agg(F.count(F.lit(1)).alias("n")))
    return maintenance.refresh_snapshot(t.spark, root, lambda: t.tele.groupBy("process").agg(F.count(F.lit(1)).alias("n")))


_SPEC = {"avg_temperature": ("avg", "temperature"), "max_time": ("max", "total_time")}
_KEYS = ["eqp_id"]


def _hourly(df: DataFrame) -> DataFrame:
    return rollup.drop_counts(rollup.rollup(df, "time", "1 hour", _KEYS, _SPEC))


_HOURLY_SQL = f"SELECT time_bucket(INTERVAL '1 hour', time) AS bucket, eqp_id, count(*) AS sample_count, {r('avg(temperature)', 4)} AS avg_temperature, {r('max(total_time)', 4)} AS max_time FROM tele WHERE {{w}} GROUP BY 1, 2"


def _out(df: DataFrame) -> DataFrame:
    return df.select("bucket", "eqp_id", "sample_count", fn.rnd("avg_temperature", 4).alias("avg_temperature"), fn.rnd("max_time", 4).alias("max_time"))


@query("mnt6_refresh_rollup", "tele", _HOURLY_SQL.format(w="time < TIMESTAMP '2024-01-30 23:00:00'"))
def _(t):
    path = scratch_path(t.spark, "rollup")
    # first the history, then a refresh that re-opens three days and stops an hour before the present
    early = t.tele.where(F.col("time") < fn.ts_lit("2024-01-28 07:30:00"))
    maintenance.refresh_rollup(early, path, _hourly, "time", "1 hour", "2024-01-28 08:00:00", "60 days", "0 seconds")
    out = maintenance.refresh_rollup(t.tele, path, _hourly, "time", "1 hour", AS_OF, *maintenance.REFRESH["telemetry_hourly"])
    return _out(out)


@query("mnt7_realtime_rollup", "tele", _HOURLY_SQL.format(w="true"))
def _(t):
    path = scratch_path(t.spark, "rollup")
    mat = maintenance.refresh_rollup(t.tele, path, _hourly, "time", "1 hour", "2024-01-20 00:00:00", "60 days", "0 seconds")
    # stored buckets overlap the live range; each bucket must count once
    return _out(maintenance.realtime_rollup(mat.drop("date"), t.tele, _hourly, "time", "2024-01-18 00:00:00"))
