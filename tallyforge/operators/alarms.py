"""Alarm operations: severity, action queue, response times, debounce, lifecycle, alert handling."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import (
    classify_severity, elapsed_text, in_or_all, last, max_abs, minus, owner_action, rnd, seconds_between, time_bucket, time_range, ts_lit,
)
from ..functions.labels import category_owner
from ..functions.timeutil import interval_us
from ..schema import PE_COLS
from .aggregates import with_fallback_row
from .joins import asof_nearest, bounded_join
from .machines import in_chunks
from .recurrences import Cooldown, Held
from .series import over_rows
from .spc import NO_RECIPE_SETTING


def with_severity(catalog: DataFrame) -> DataFrame:
    """Catalog with computed severity; the literal text 'NULL' in the detail becomes NULL."""
    return catalog.withColumns(
        {"severity": classify_severity(F.col("alarm_msg"), F.col("alarm_type")), "alarm_detail": F.nullif(F.col("alarm_detail"), F.lit("NULL"))}
    )


def severity_rank(c: str = "severity") -> Column:
    return F.when(F.col(c) == "Critical", 0).when(F.col(c) == "Major", 1).when(F.col(c) == "NONE", 2).otherwise(3)


def action_queue(
    alarms: DataFrame, catalog: DataFrame, tele: DataFrame, lifecycle: DataFrame, category: DataFrame, as_of: datetime | str,
    window: str = "5 minutes", machines: list[str] | None = None, k: int | None = 50,
) -> DataFrame:
    """Unresolved critical and major alarms with owner, action and age; one NONE row when there are none."""
    codes = catalog.where(F.col("severity").isin("Critical", "Major")).select(
        F.col("alarm_code").alias("errorcode"), "severity", "alarm_type", "alarm_msg", "alarm_detail"
    )
    recent = last(alarms, "logdate", window, as_of).where(in_or_all("equipmentid", machines))
    status = lifecycle.select("logdate", "logid", "status")
    rows = recent.join(codes, "errorcode").join(status, ["logdate", "logid"], "left").where(~F.col("status").eqNullSafe("RESOLVED"))
    # no row further back can be within ten minutes of an alarm of the window
    near = tele.where(F.col("time") >= ts_lit(minus(minus(as_of, window), "10 minutes")))
    jobs = near.select(F.col("log_id").alias("related_log_id"), F.col("time").alias("_t"), F.col("factory").alias("_f"), "mo")
    rows = bounded_join(rows, jobs, ["related_log_id"], "logdate", "_t", "10 minutes", "10 minutes")
    rows = rows.join(category.select(F.col("alarm_code").alias("errorcode"), "category"), "errorcode", "left")
    owner = category_owner(F.coalesce("category", F.lit("UNCLASSIFIED")))
    queue = rows.select(
        "logid", "related_log_id", "logdate", F.col("equipmentid").alias("machine"), "severity", "status", "alarm_type",
        "alarm_msg", "alarm_detail", F.coalesce("_f", "factory").alias("factory"), "mo", F.col("logdate").alias("when"),
        F.floor(F.unix_micros("logdate") / 1000).alias("when_ms"),
        elapsed_text(seconds_between(ts_lit(as_of), F.col("logdate"))).alias("elapsed"),
        owner.alias("owner"), owner_action(owner).alias("action"),
    )
    spark = queue.sparkSession
    empty = spark.range(1).select(
        F.lit("NONE").alias("severity"), F.lit("NONE").alias("status"), F.lit("NO ACTIVE CRITICAL/MAJOR ALARMS").alias("alarm_msg"),
        ts_lit(as_of).alias("when"), F.lit(0).cast("long").alias("when_ms"),
    )
    if k is None:
        return with_fallback_row(queue, empty)
    # the k rows first, the one that stands for none among them last; it goes where there is another
    both = queue.withColumn("_none", F.lit(0)).unionByName(empty.withColumn("_none", F.lit(1)), allowMissingColumns=True)
    first = both.orderBy("_none", severity_rank(), F.desc("when"), "logid").limit(k)
    kept = first.withColumn("_some", F.min("_none").over(Window.partitionBy(F.lit(1)))).where("_none = _some")
    return kept.orderBy(severity_rank(), F.desc("when"), "logid").drop("_none", "_some")


def response_times(lifecycle: DataFrame, as_of: datetime | str | None = None, window: str | None = "24 hours", grain: str | None = None) -> DataFrame:
    """Mean minutes to acknowledge and to resolve, over a window, all time, or per bucket of `grain`."""
    rows = last(lifecycle, "logdate", window, as_of) if window else lifecycle

    def minutes(c: str) -> Column:
        return rnd(F.avg(seconds_between(F.col(c), F.col("logdate"))) / 60, 1)

    aggs = [minutes("acknowledged_at").alias("mtta_min"), minutes("resolved_at").alias("mttr_min")]
    if grain is None:
        return rows.agg(*aggs)
    touched = F.col("acknowledged_at").isNotNull() | F.col("resolved_at").isNotNull()
    return rows.where(touched).groupBy(time_bucket("logdate", grain).alias("bucket")).agg(*aggs)


def open_triage(lifecycle: DataFrame, alarms: DataFrame, catalog: DataFrame, as_of: datetime | str, k: int = 20) -> DataFrame:
    """Open alarms waiting longest. The k oldest are picked before the catalog is joined."""
    waiting = (
        lifecycle.where(F.col("status") == "OPEN").select("logdate", "logid")
        .join(alarms.select("logdate", "logid", "equipmentid", "errorcode"), ["logdate", "logid"])
        .orderBy("logdate", "logid").limit(k)
    )
    codes = catalog.select(F.col("alarm_code").alias("errorcode"), "severity", "alarm_msg")
    return waiting.join(codes, "errorcode", "left").select(
        F.col("equipmentid").alias("machine"), "severity", F.col("alarm_msg").alias("alarm"), F.col("logdate").alias("fired_at"),
        rnd(seconds_between(ts_lit(as_of), F.col("logdate")) / 60, 1).alias("waiting_min"),
    )


def lifecycle_quality(lifecycle: DataFrame, alarms: DataFrame, as_of: datetime | str, open_for: str = "4 hours", ack_for: str = "2 hours") -> DataFrame:
    """Counts of alarms stuck OPEN, stuck ACKNOWLEDGED, and lifecycle rows without an alarm."""
    def older(c: str, width: str) -> Column:
        return F.col(c) < ts_lit(as_of) - F.make_dt_interval(secs=F.lit(interval_us(width) // 1_000_000))

    stuck = lifecycle.agg(
        F.count_if((F.col("status") == "OPEN") & older("logdate", open_for)).alias("stuck_open"),
        F.count_if((F.col("status") == "ACKNOWLEDGED") & older("acknowledged_at", ack_for)).alias("stuck_ack"),
    )
    lost = lifecycle.join(alarms.select("logdate", "logid"), ["logdate", "logid"], "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    return stuck.withColumn("orphans", lost.scalar())


def burst_report(alarms: DataFrame, gap: str = "15 seconds", k: int | None = 5, max_rows: int | None = None) -> DataFrame:
    """Machine and code pairs that refire within `gap`, most repeats first."""
    gaps = alarm_gaps(alarms, max_rows).where(F.col("gap_us") < interval_us(gap))
    out = gaps.groupBy("equipmentid", "errorcode").agg(F.count(F.lit(1)).alias("repeats"))
    return out if k is None else out.orderBy(F.desc("repeats"), "equipmentid", "errorcode").limit(k)


def alarm_gaps(alarms: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Microseconds since the previous firing of the same machine and code."""
    rows = alarms.select("equipmentid", "errorcode", "logdate", "logid")

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("gap_us", F.unix_micros("logdate") - F.unix_micros(F.lag("logdate").over(w)))

    return over_rows(rows, ["equipmentid", "errorcode"], ["logdate", "logid"], 1, build, max_rows)


def code_lookup(catalog: DataFrame, code: str) -> DataFrame:
    """Catalog entry by id or code."""
    return catalog.where((F.col("alarm_id") == code) | (F.col("alarm_code") == code)).select(
        "alarm_id", "alarm_type", "alarm_msg", "alarm_detail", "severity", "cause", "impact", "recovery_action",
        F.coalesce("sop_reference", F.lit("Not yet available")).alias("sop_reference"),
    ).orderBy("alarm_id").limit(1)


def recent_occurrences(alarms: DataFrame, code: str, k: int = 20) -> DataFrame:
    return alarms.where(F.col("errorcode") == code).orderBy(F.desc("logdate"), F.desc("logid")).limit(k).select(
        "logdate", "equipmentid", "logid", "related_log_id", F.coalesce("link_basis", F.lit("nearest")).alias("link_basis")
    )


def alarm_pareto(alarms: DataFrame) -> DataFrame:
    """Counts per code with cumulative share. The final window runs over one row per code, not over alarms."""
    per_code = alarms.groupBy("errorcode").agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.orderBy(F.desc("n"), "errorcode").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return per_code.select("errorcode", "n", rnd(F.sum("n").over(ordered) * 100.0 / total, 2).alias("cum_pct"))


def quality_drift(tele: DataFrame, as_of: datetime | str, samples: list[str] = PE_COLS, setting: str = "pe_setting", window: str = "10 minutes", step: str = "5 minutes") -> DataFrame:
    """Buckets whose largest error exceeds the tolerance."""
    rows = last(tele, "time", window, as_of, inclusive=True).where(
        F.col(samples[0]).isNotNull() & (F.coalesce(F.col(setting), F.lit(0.0)) > NO_RECIPE_SETTING)
    )
    return (
        rows.groupBy(time_bucket("time", step).alias("bucket"), "eqp_id")
        .agg(F.max(max_abs(samples, coalesce0=False)).alias("_v"), F.max(setting).alias("_s"))
        .where(F.col("_v") > F.col("_s")).select("bucket", "eqp_id", rnd("_v", 4).alias("value"))
    )


def new_alarms(alarms: DataFrame, as_of: datetime | str, window: str = "5 minutes") -> DataFrame:
    return last(alarms, "logdate", window, as_of, inclusive=True).select("logdate", F.col("equipmentid").alias("eqp_id"), F.lit(1).alias("value"))


def temp_high(tele: DataFrame, as_of: datetime | str, window: str = "10 minutes", step: str = "5 minutes", limit: float = 24.0) -> DataFrame:
    """Buckets with readings above the temperature limit, and the mean of those readings."""
    return (
        last(tele, "time", window, as_of, inclusive=True).where((F.col("temperature") > limit) & (F.col("temperature") > 0))
        .groupBy(time_bucket("time", step).alias("bucket"), "eqp_id")
        .agg(rnd(F.avg("temperature"), 4).alias("value"))
    )


# ---------------------------------------------------------------------------------------------- debounce


def debounce(alarms: DataFrame, keys: list[str] | None = None, cooldown: str = "12 minutes", ts: str = "logdate", tie: str = "logid", max_rows: int | None = None) -> DataFrame:
    """Mark the alarms that fire: an alarm is suppressed within `cooldown` of the last one of its key that fired."""
    keys = keys or ["equipmentid", "errorcode"]
    return in_chunks(alarms, keys, [ts, tie], Cooldown(ts, cooldown), {"fired": "boolean"}, max_rows)


def debounce_state(marked: DataFrame, keys: list[str] | None = None, ts: str = "logdate") -> DataFrame:
    """first_fired, last_fired and fire_count per key, of the alarms that fired."""
    keys = keys or ["equipmentid", "errorcode"]
    return marked.where("fired").groupBy(*keys).agg(
        F.min(ts).alias("first_fired"), F.max(ts).alias("last_fired"), F.count(F.lit(1)).cast("int").alias("fire_count")
    )


# ---------------------------------------------------------------------------------------------- lifecycle

ACK, RESOLVE = "ACKNOWLEDGED", "RESOLVED"


def lifecycle_fold(alarms: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply operator actions (`action` = target status) in time order; return (state, rejected actions).

    OPEN at birth; ACKNOWLEDGED from OPEN with an actor; RESOLVED from OPEN or ACKNOWLEDGED with an actor, and final.
    The first valid resolve and the first valid acknowledge before it decide the state, so it is an aggregation.
    """
    key = ["logdate", "logid"]
    order = F.struct("action_ts", "action_id")
    has_actor = F.trim(F.coalesce(F.col("actor"), F.lit(""))) != ""
    ask = F.col("action")
    acts = actions.withColumns({"_o": order, "_ok": has_actor})
    res = acts.groupBy(*key).agg(F.min(F.when((ask == RESOLVE) & F.col("_ok"), F.col("_o"))).alias("_res"))
    timed = acts.join(res, key)
    early = F.col("_res").isNull() | (F.col("_o") < F.col("_res"))
    decided = timed.groupBy(*key).agg(
        F.first("_res").alias("_res"),
        F.min(F.when((ask == ACK) & F.col("_ok") & early, F.col("_o"))).alias("_ack"),
        F.min_by("actor", F.when((ask == ACK) & F.col("_ok") & early, F.col("_o"))).alias("acknowledged_by"),
        F.min_by("actor", F.when((ask == RESOLVE) & F.col("_ok"), F.col("_o"))).alias("resolved_by"),
        F.min_by("note", F.when((ask == RESOLVE) & F.col("_ok"), F.col("_o"))).alias("resolution_note"),
    )
    status = F.when(F.col("_res").isNotNull(), RESOLVE).when(F.col("_ack").isNotNull(), ACK).otherwise("OPEN")
    at, done = F.col("_ack")["action_ts"], F.col("_res")["action_ts"]
    state = alarms.select(*key).join(decided, key, "left").select(
        "logid", "logdate", status.alias("status"), at.alias("acknowledged_at"), "acknowledged_by", done.alias("resolved_at"),
        "resolved_by", "resolution_note", F.coalesce(done, at, F.col("logdate")).alias("updated_at"),
    )
    known = alarms.select(*key).withColumn("_known", F.lit(True))
    judged = acts.join(decided.select(*key, "_res", "_ack"), key, "left").join(known, key, "left")
    after_res = F.col("_res").isNotNull() & (F.col("_o") > F.col("_res"))
    after_ack = F.col("_ack").isNotNull() & (F.col("_o") > F.col("_ack"))
    reason = (
        F.when(F.col("_known").isNull(), F.lit("unknown alarm"))
        .when(after_res, F.lit("RESOLVED is final"))
        .when(~ask.isin(ACK, RESOLVE), F.concat(F.lit("no transition to "), ask))
        .when(~F.col("_ok"), F.lit("actor required"))
        .when((ask == ACK) & after_ack, F.lit("not OPEN"))
    )
    rejected = judged.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*actions.columns, "reason")
    return state, rejected


# ---------------------------------------------------------------------------------------------- linking


def link_alarms(alarms: DataFrame, tele: DataFrame, tol: str = "2 minutes", prune: bool = True, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(linked, rejected): a missing related_log_id is filled with the nearest row within `tol`, a given one must exist.

    `ids`: the telemetry that a given id may name, where `tele` is only a part of it.
    """
    own = alarms.columns
    open_ = alarms.where(F.col("related_log_id").isNull())
    found = asof_nearest(
        open_.drop("related_log_id"), tele, "equipmentid", "logdate", tol, {"related_log_id": "log_id"},
        right_by="eqp_id", right_ts="time", prune=prune,
    ).withColumn("link_basis", F.when(F.col("related_log_id").isNotNull(), "nearest"))
    given = alarms.where(F.col("related_log_id").isNotNull())
    ids = (tele if ids is None else ids).select(F.col("log_id").alias("related_log_id"))
    valid = given.join(ids, "related_log_id", "left_semi").withColumn("link_basis", F.lit("causal"))
    rejected = given.join(ids, "related_log_id", "left_anti")
    return found.select(*own).unionByName(valid.select(*own)), rejected.select(*own)


# ---------------------------------------------------------------------------------------------- alerts


def sustained(evals: DataFrame, keys: list[str], hold: str, step: str, ts: str = "ts", cond: str = "cond", max_rows: int | None = None) -> DataFrame:
    """pending / firing per evaluation: the condition must hold at every evaluation across `hold`.

    Evaluations sit on a grid of `step`; a missing one breaks the run.
    """
    marked = in_chunks(evals, keys, [ts], Held(ts, cond, interval_us(step)), {"since": "long"}, max_rows)
    firing = F.unix_micros(ts) - F.col("since") >= interval_us(hold)
    state = F.when(F.col("since") < 0, "ok").when(firing, "firing").otherwise("pending")
    return marked.withColumn("state", state).drop("since")


def group_alerts(alerts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One notification per group: counts and time range, not a collected list of its alerts."""
    by = by or ["alertname", "device_id", "device_type"]
    return alerts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# Fixed values: (source condition, suppressed condition, columns that must agree).
INHIBIT_RULES = [
    ("alertname = 'ServiceDown'", "alertname IN ('ServiceHighLatency', 'SLABreachWarning')", ["instance"]),
    ("severity = 'critical'", "severity = 'warning'", ["device_id"]),
    ("alertname = 'InterfaceDown'", "alertname = 'BandwidthSaturation'", ["device_id"]),
]


def inhibit(alerts: DataFrame, rules: list[tuple[str, str, list[str]]] = INHIBIT_RULES) -> DataFrame:
    """Alerts left after suppression; every rule looks at the full set of alerts as its sources."""
    out = alerts
    for i, (source, target, equal) in enumerate(rules):
        # one row per suppressing key, so a key with many alerts stays one row
        sources = alerts.where(F.expr(source)).select(*[F.col(c).alias(f"_s{i}_{c}") for c in equal]).distinct()
        same = [F.col(c).eqNullSafe(F.col(f"_s{i}_{c}")) for c in equal]
        match = F.expr(target)
        for s in same:
            match = match & s
        out = out.join(sources, match, "left_anti")
    return out
