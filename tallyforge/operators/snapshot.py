"""Machine snapshots, states, timelines and the grids drawn from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import elapsed_text, last, minus, rnd, seconds_between, spec_flag_columns, time_bucket, ts_lit, ts_plus
from ..functions.labels import category_owner
from ..functions.timeutil import interval_us
from .aggregates import union_events
from .joins import asof_nearest, latest_per_key
from .rca import category_column
from .series import over_rows


def machine_snapshot(tele: DataFrame, alarms: DataFrame, catalog: DataFrame, tol: str = "2 minutes") -> DataFrame:
    """Every telemetry row with the alarm nearest in time on its machine, and that alarm's text."""
    take = {"alarm_errorcode": "errorcode", "alarm_errortime": "errortime", "alarm_logid": "logid"}
    near = asof_nearest(tele, alarms, "eqp_id", "time", tol, take, right_by="equipmentid", right_ts="logdate", right_id="logid")
    text = catalog.select(F.col("alarm_code").alias("alarm_errorcode"), "alarm_type", "alarm_msg", "alarm_detail")
    return near.join(text, "alarm_errorcode", "left")


def latest_full(devices: DataFrame, tele: DataFrame, as_of: datetime | str, device_type: str = "ldi", stale: str = "5 minutes", stored: bool = False) -> DataFrame:
    """Newest row of every enabled registered machine, with has_data and is_stale.

    `stored`: `tele` holds one row a machine already, as `sources.latest` keeps them, and is read as it is.
    """
    fleet = devices.where((F.col("device_type") == device_type) & F.col("enabled")).select(
        F.col("device_id").alias("eqp_id"), "hostname", "location", "enabled"
    )
    newest = tele if stored else latest_per_key(tele, ["eqp_id"], "time", "log_id")
    out = fleet.join(newest, "eqp_id", "left")
    has = F.col("time").isNotNull()
    return out.withColumns({"has_data": has, "is_stale": has & (F.col("time") < ts_lit(minus(as_of, stale)))})


def _transitions(tele: DataFrame, max_rows: int | None) -> DataFrame:
    rows = tele.select("time", "eqp_id", "log_id", "state")

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("_was", F.lag("state").over(w))

    out = over_rows(rows, ["eqp_id"], ["time", "log_id"], 1, build, max_rows)
    return out.where(F.col("state") != F.col("_was"))


def event_timeline(tele: DataFrame, alarms: DataFrame, catalog: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Machine starts and stops together with alarms, as one stream of events."""
    up = F.col("state")
    changes = _transitions(tele, max_rows).select(
        F.col("time").alias("event_time"), "eqp_id",
        F.when(up, "Machine Start").otherwise("Machine Stop").alias("event_type"),
        F.lit("telemetry").alias("source"),
        F.when(up, "state changed to RUNNING").otherwise("state changed to DOWN").alias("description"),
    )
    text = catalog.select(F.col("alarm_code").alias("errorcode"), "alarm_msg")
    fired = alarms.join(text, "errorcode", "left").select(
        F.col("logdate").alias("event_time"), F.col("equipmentid").alias("eqp_id"), F.lit("Alarm").alias("event_type"),
        F.lit("alarm_log").alias("source"), F.coalesce("alarm_msg", "errorcode").alias("description"),
    )
    return union_events(changes, fired)


def around_event(tele: DataFrame, alarms: DataFrame, log_id: str, span: str = "10 minutes") -> DataFrame:
    """Telemetry rows and alarms of one machine within `span` of a selected telemetry row."""
    us = interval_us(span)
    pick = tele.where(F.col("log_id") == log_id).select(F.col("eqp_id").alias("_e"), F.col("time").alias("_at"))
    events = union_events(
        tele.select(F.col("time").alias("event_time"), "eqp_id", F.lit("telemetry").alias("source"), F.col("log_id").alias("ref")),
        alarms.select(F.col("logdate").alias("event_time"), F.col("equipmentid").alias("eqp_id"), F.lit("alarm").alias("source"), F.col("logid").alias("ref")),
    )
    near = F.col("event_time").between(ts_plus("_at", -us), ts_plus("_at", us))
    return events.join(pick, (F.col("eqp_id") == F.col("_e")) & near).select("event_time", "eqp_id", "source", "ref")


def machine_state(
    latest: DataFrame, alarms: DataFrame, catalog: DataFrame, lifecycle: DataFrame, as_of: datetime | str, window: str = "5 minutes",
) -> DataFrame:
    """3 ALARM / 0 NO_DATA / 2 OK / 1 IDLE per machine, with the top unresolved alarm."""
    codes = catalog.where(F.col("severity").isin("Critical", "Major")).select(F.col("alarm_code").alias("errorcode"), "severity")
    status = lifecycle.select("logdate", "logid", "status")
    recent = last(alarms, "logdate", window, as_of).join(codes, "errorcode").join(status, ["logdate", "logid"], "left")
    open_ = ~F.col("status").eqNullSafe("RESOLVED")
    age = seconds_between(ts_lit(as_of), F.col("logdate"))
    # newest of the most severe first; the id makes the pick reproducible
    rank = F.struct(F.when(F.col("severity") == "Critical", 0).otherwise(1), -F.unix_micros("logdate"), F.col("logid"))
    top = F.struct(
        category_owner(category_column(F.col("errorcode"))).alias("owner"), elapsed_text(age).alias("elapsed"),
        "related_log_id", F.floor(F.unix_micros("logdate") / 1000).alias("ms"),
    )
    per_machine = recent.groupBy(F.col("equipmentid").alias("eqp_id")).agg(
        F.count(F.lit(1)).alias("_any"), F.count_if(open_).alias("_open"), F.min_by(F.when(open_, top), F.when(open_, rank)).alias("_top")
    )
    out = latest.join(per_machine, "eqp_id", "left")
    state = (
        F.when(F.col("_any") > 0, 3).when(~F.col("has_data") | F.col("is_stale"), 0).when(F.col("state"), 2).otherwise(1)
    )
    return out.select(
        "eqp_id", state.alias("state"), "board_no", "total_board", "mo", "factory",
        F.coalesce("_open", F.lit(0)).cast("int").alias("alarm_count"),
        F.col("_top")["owner"].alias("alarm_owner"), F.col("_top")["elapsed"].alias("alarm_elapsed"),
        F.col("_top")["related_log_id"].alias("alarm_related_log_id"), F.col("_top")["ms"].alias("alarm_logdate_ms"),
    )


def fleet_kpis(latest: DataFrame, alarms: DataFrame, catalog: DataFrame, as_of: datetime | str, window: str = "1 hour") -> DataFrame:
    """Availability %, running machines, and critical/major alarms of the window, as one row."""
    running = F.count_if(F.col("state"))
    fleet = latest.agg(rnd(running * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0)), 0).alias("availability_pct"), running.alias("running"))
    severe = catalog.where(F.col("severity").isin("Critical", "Major")).select(F.col("alarm_code").alias("errorcode"))
    count = last(alarms, "logdate", window, as_of).join(severe, "errorcode").agg(F.count(F.lit(1)).alias("critical_major"))
    return fleet.withColumn("critical_major", count.scalar())


def env_compliance(latest: DataFrame) -> DataFrame:
    """Share of reporting machines inside the temperature and humidity limits."""
    out = spec_flag_columns()["flag_temp_out_of_spec"]
    known = F.col("temperature").isNotNull() & F.col("humidity").isNotNull()
    ok = F.count_if(known & ~out)
    return latest.agg(
        F.count_if(known).alias("reporting"), ok.alias("in_spec"),
        rnd(ok * 100.0 / F.nullif(F.count_if(known), F.lit(0)), 1).alias("compliance_pct"),
    )


def env_timeline(tele: DataFrame, step: str = "1 hour") -> DataFrame:
    """In-spec share per machine and bucket."""
    out = spec_flag_columns()["flag_temp_out_of_spec"]
    return tele.groupBy("eqp_id", time_bucket("time", step).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.count_if(~out) * 100.0 / F.count(F.lit(1)), 1).alias("in_spec_pct")
    )


def not_producing(states: DataFrame) -> DataFrame:
    return states.agg(F.count_if(F.col("state") != 2).alias("not_producing"), F.count(F.lit(1)).alias("machines"))


def grid_steps(lo: datetime | str, hi: datetime | str, step: str) -> Column:
    """The steps of [lo, hi), as an array."""
    end = ts_plus(ts_lit(hi), -interval_us(step))
    seconds = interval_us(step) // 1_000_000
    return F.sequence(ts_lit(lo), end, F.make_dt_interval(secs=F.lit(seconds)))


def time_grid(rows: DataFrame, lo: datetime | str, hi: datetime | str, step: str, name: str = "bucket") -> DataFrame:
    """Every row of `rows` for every step of [lo, hi)."""
    return rows.withColumn(name, F.explode(grid_steps(lo, hi, step)))


# steps of a grid that travel as one row
_BLOCK = 64


def state_grid(tele: DataFrame, devices: DataFrame, lo: datetime | str, hi: datetime | str, step: str = "5 minutes", device_type: str = "ldi") -> DataFrame:
    """RUNNING / IDLE / NO_DATA per machine and step: the last state seen inside the step.

    Machines meet the steps they were seen in by blocks of steps; the grid itself is laid out after that and never shuffled.
    """
    width, first = interval_us(step), F.unix_micros(ts_lit(lo))
    fleet = devices.where((F.col("device_type") == device_type) & F.col("enabled")).select(F.col("device_id").alias("eqp_id"))
    seen = (
        tele.where((F.col("time") >= ts_lit(lo)) & (F.col("time") < ts_lit(hi)))
        .groupBy("eqp_id", time_bucket("time", step).alias("bucket"))
        .agg(F.max_by("state", F.struct("time", "log_id")).alias("_state"))
    )
    label = F.when(F.col("_state").isNull(), "NO_DATA").when(F.col("_state"), "RUNNING").otherwise("IDLE")
    at = F.unix_micros("bucket") - first
    steps = grid_steps(lo, hi, step)
    # buckets between the steps, where `lo` is none, or after the last one meet no step
    on_grid = seen.where((at % width == 0) & (F.col("bucket") <= F.element_at(steps, -1))).withColumn("_block", F.floor(at / (width * _BLOCK)))
    told = on_grid.groupBy("eqp_id", "_block").agg(F.collect_list(F.struct("bucket", label.alias("state"))).alias("_seen"))
    blocks = fleet.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.size(steps) - 1) / _BLOCK))))
    own = F.slice(steps, (F.col("_block") * _BLOCK + 1).cast("int"), _BLOCK)
    held = F.coalesce(F.col("_seen"), F.expr("array()").cast("array<struct<bucket:timestamp,state:string>>"))
    empty = F.transform(F.array_except(own, F.transform(held, lambda s: s["bucket"])), lambda b: F.struct(b.alias("bucket"), F.lit("NO_DATA").alias("state")))
    # blocks are dealt out even where the few machines fit one task: the rows they stand for would not
    return blocks.repartition("eqp_id", "_block").join(told, ["eqp_id", "_block"], "left").select("eqp_id", F.inline(F.concat(held, empty))).select("bucket", "eqp_id", "state")


def cycle_time_grid(tele: DataFrame, step: str = "5 minutes") -> DataFrame:
    """Average cycle time per machine and step."""
    return tele.groupBy("eqp_id", time_bucket("time", step).alias("bucket")).agg(
        rnd(F.avg("total_time"), 3).alias("avg_total_time"), F.count(F.lit(1)).alias("n")
    )


def fleet_cycle_time(tele: DataFrame) -> DataFrame:
    cycle = F.col("total_time").cast("double") / F.nullif(F.col("total_board").cast("double"), F.lit(0.0))
    return tele.agg(rnd(F.avg(cycle), 4).alias("avg_cycle_time"), F.count(cycle).alias("n"))


def detect_alarms(tele: DataFrame, as_of: datetime | str, window: str = "3 minutes") -> DataFrame:
    """One alarm per violated specification on the newest row of each machine, carrying the causing row's id."""
    # Code raised for each violated specification.
    rules = [
        ("91008", "flag_temp_out_of_spec"), ("90005", "flag_pe_out_of_spec"),
        ("70004", "flag_scan_speed_out_of_spec"), ("91009", "flag_vac_out_of_spec"),
    ]
    newest = latest_per_key(last(tele, "time", window, as_of), ["eqp_id"], "time", "log_id")
    flags = spec_flag_columns()
    codes: Column = F.array_compact(F.array(*[F.when(flags[f], code) for code, f in rules]))
    return newest.select("eqp_id", "process", "time", "log_id", F.explode(codes).alias("errorcode")).select(
        F.concat_ws("-", F.lit("ALM"), "eqp_id", "errorcode", "log_id").alias("logid"), ts_lit(as_of).alias("logdate"),
        "errorcode", F.col("eqp_id").alias("equipmentid"), "process", F.col("log_id").alias("related_log_id"),
        F.lit("causal").alias("link_basis"),
    )
