"""Infrastructure health: scores, uptime, forecasts, threshold and anomaly alerts, counter rates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import freshness, health_score, last, minus, pct, pg_int, rnd, scope_devices, seconds_between, time_bucket, ts_lit
from ..functions.timeutil import interval_us
from .alarms import sustained
from .joins import latest_per_key
from .machines import in_chunks
from .recurrences import Held, Recent, Together
from .series import over_rows


def fleet_health(sys: DataFrame, devices: DataFrame, as_of: datetime | str, window: str = "5 minutes") -> DataFrame:
    """Newest reading and penalty score of every enabled server."""
    recent = scope_devices(last(sys, "time", window, as_of), devices, "server")
    newest = latest_per_key(recent, ["device_id"], "time")
    ram, disk = pct("ram_used_mb", "ram_total_mb"), pct("disk_used_gb", "disk_total_gb")
    return newest.select(
        F.col("device_id").alias("machine_id"), rnd("cpu_load_percent", 1).alias("cpu_pct"), rnd(ram, 1).alias("ram_pct"),
        rnd(disk, 1).alias("disk_pct"), rnd("temp_c", 0).alias("temp_c"),
        rnd(health_score(F.col("cpu_load_percent"), ram, disk), 1).alias("health_score"), "time",
    )


def fleet_score(health: DataFrame) -> DataFrame:
    return health.agg(F.lit("Fleet Score").alias("metric"), rnd(F.avg("health_score"), 1).alias("value"))


def top_nodes(health: DataFrame, k: int = 10) -> DataFrame:
    """The k unhealthiest nodes."""
    return health.select("machine_id", "health_score").orderBy(F.asc_nulls_last("health_score"), "machine_id").limit(k)


def uptime_summary(sys: DataFrame, as_of: datetime | str, window: str = "24 hours") -> DataFrame:
    stats = last(sys, "time", window, as_of).groupBy(F.col("device_id").alias("machine_id")).agg(
        F.max("time").alias("last_seen"), F.avg("cpu_load_percent").alias("_c"), F.avg("temp_c").alias("_t")
    )
    age = seconds_between(ts_lit(as_of), F.col("last_seen"))
    return stats.select(
        "machine_id", "last_seen", pg_int(age).alias("seconds_since_last"), freshness(age).alias("health_status"),
        rnd("_c", 2).alias("current_cpu"), rnd("_t", 1).alias("current_temp"),
    )


def fleet_uptime(uptime: DataFrame) -> DataFrame:
    online = F.count_if(F.col("health_status") == "online")
    return uptime.agg(rnd(online * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0)), 2).alias("value"))


def resource_forecast(
    hourly: DataFrame, used: str, total: str, as_of: datetime | str, days: int = 30, min_pts: int = 7, horizon: int = 3650,
) -> DataFrame:
    """Linear trend of daily means and the day a resource runs out.

    Days are capped at `horizon`; no growth gives NULL; already full gives 0 and the present time.
    """
    daily = (
        last(hourly, "bucket", f"{days} days", as_of).where(F.col(total) > 0)
        .groupBy("device_id", time_bucket("bucket", "1 day").alias("day"))
        .agg(F.avg(used).alias("used"), F.avg(total).alias("total"))
        .withColumn("day_num", F.unix_seconds("day") / 86400)
    )
    fit = daily.groupBy("device_id").agg(
        F.coalesce(F.regr_slope("used", "day_num"), F.lit(0.0)).alias("slope"), F.max("used").alias("current"),
        F.max("total").alias("capacity"), F.count(F.lit(1)).alias("data_points"),
    ).where(F.col("data_points") >= min_pts)
    slope = F.col("slope")
    left = F.least((F.col("capacity") - F.col("current")) / F.nullif(slope, F.lit(0.0)), F.lit(float(horizon)))
    full = F.col("capacity") <= F.col("current")
    end = F.timestamp_micros(F.unix_micros(ts_lit(as_of)) + (left * 86_400_000_000).cast("long"))
    return fit.select(
        "device_id", rnd("current", 2).alias("current_usage"), rnd("capacity", 2).alias("total"),
        rnd("slope", 4).alias("daily_growth"),
        F.when(slope <= 0, None).when(full, 0.0).otherwise(rnd(left, 0)).alias("days_until_full"),
        F.when(slope <= 0, None).when(full, ts_lit(as_of)).otherwise(F.date_trunc("day", end)).alias("projected_full_date"),
        "data_points",
    )


def disk_forecast(hourly: DataFrame, as_of: datetime | str, days: int = 30, min_pts: int = 7) -> DataFrame:
    return resource_forecast(hourly, "avg_disk_used", "avg_disk_total", as_of, days, min_pts)


def saturation_forecast(net: DataFrame, as_of: datetime | str, window: str = "5 minutes", mean: float = 800.0, ceiling: float = 1000.0, min_pts: int = 5) -> DataFrame:
    """Busy devices whose receive rate, extrapolated one hour, passes the ceiling."""
    x = seconds_between(F.col("time"), ts_lit(as_of))
    stats = last(net, "time", window, as_of).groupBy("device_id").agg(
        F.avg("rx_mbps").alias("value"), F.count(F.lit(1)).alias("n"),
        F.regr_slope(F.col("rx_mbps"), x).alias("slope"), F.regr_intercept(F.col("rx_mbps"), x).alias("icpt"),
    )
    hot = (F.col("value") > mean) & (F.col("n") >= min_pts) & (F.col("slope") > 0)
    return stats.where(hot & (F.col("slope") * 3600 + F.col("icpt") > ceiling)).select("device_id", rnd("value", 2).alias("value"))


@dataclass(frozen=True)
class ThresholdRule:
    """Aggregate of a table's recent rows compared with a limit.

    `threshold_alerts` evaluates a rule once; `sustained_alerts` evaluates it again and again and applies the hold time.
    """

    name: str
    keys: tuple[str, ...]
    value: Callable[[], Column]
    limit: float
    window: str
    severity: str
    hold: str = "0 minutes"
    enabled_only: bool = False


def _avg_share(used: str, total: str) -> Callable[[], Column]:
    return lambda: F.avg(used) / F.nullif(F.avg(total), F.lit(0.0)) * 100


# Limits, windows and hold times of the shipped alert rules.
SYS_RULES = [
    ThresholdRule("cpu_high", ("device_id",), lambda: F.avg("cpu_load_percent"), 85.0, "5 minutes", "warning", "5 minutes"),
    ThresholdRule("ram_high", ("device_id",), _avg_share("ram_used_mb", "ram_total_mb"), 90.0, "5 minutes", "warning", "5 minutes"),
    ThresholdRule("disk_high", ("device_id",), _avg_share("disk_used_gb", "disk_total_gb"), 90.0, "10 minutes", "critical", "10 minutes"),
    ThresholdRule("temp_high", ("device_id",), lambda: F.max("temp_c"), 80.0, "5 minutes", "critical", "5 minutes"),
]
NET_RULES = [
    ThresholdRule("net_errors", ("device_id", "iface_name"), lambda: F.sum("rx_errors"), 100.0, "5 minutes", "warning", "2 minutes", True),
    ThresholdRule("net_drops", ("device_id", "iface_name"), lambda: F.max("rx_drops"), 50.0, "5 minutes", "critical", "2 minutes"),
]
MACHINE_RULES = [
    ThresholdRule("vibration_critical", ("device_id",), lambda: F.max("vibration"), 12.0, "5 minutes", "critical", "1 minute"),
]


def threshold_alerts(df: DataFrame, rules: list[ThresholdRule], as_of: datetime | str, devices: DataFrame | None = None, window: str | None = None) -> DataFrame:
    """Alerts of a table's rules. Rules that share keys, window and scope share one aggregation."""
    groups: dict[tuple, list[ThresholdRule]] = {}
    for r in rules:
        groups.setdefault((r.keys, window or r.window, r.enabled_only), []).append(r)
    parts = []
    for (keys, width, enabled_only), members in groups.items():
        rows = last(df, "time", width, as_of)
        if enabled_only and devices is not None:
            rows = scope_devices(rows, devices)
        stats = rows.groupBy(*keys).agg(*[r.value().cast("double").alias(r.name) for r in members])
        fired = F.array(
            *[F.when(F.col(r.name) > r.limit, F.struct(F.lit(r.name).alias("rule"), F.col(r.name).alias("value"), F.lit(r.severity).alias("severity"))) for r in members]
        )
        metric = F.concat_ws(" ", *keys)
        parts.append(
            stats.select(metric.alias("metric"), F.explode(F.array_compact(fired)).alias("a")).select(
                "metric", "a.rule", rnd("a.value", 4).alias("value"), "a.severity"
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sustained_alerts(
    df: DataFrame, rules: list[ThresholdRule], devices: DataFrame | None = None, step: str = "1 minute", window: str | None = None, hold: str | None = None, ts: str = "time",
) -> DataFrame:
    """Alerts that fire: each rule's aggregate over a window that slides by `step`, above its limit for the hold time.

    One row per (rule, metric, evaluation) that is firing, with its value; `window` and `hold` override the rules'.
    """
    # rules over the same rows and windows are aggregated in one pass, and held in one
    alike: dict[tuple, list[ThresholdRule]] = {}
    for r in rules:
        alike.setdefault((tuple(r.keys), window or r.window, hold or r.hold, r.enabled_only and devices is not None), []).append(r)
    parts = []
    for (keys, span, held, scoped), own in alike.items():
        rows = scope_devices(df, devices) if scoped else df
        seen = rows.groupBy(*keys, F.window(ts, span, step).alias("_w")).agg(*[r.value().cast("double").alias(f"_v{i}") for i, r in enumerate(own)])
        told = [
            F.when(F.col(f"_v{i}") > r.limit, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(f"_v{i}").alias("value")))
            for i, r in enumerate(own)
        ]
        # on a grid an evaluation that is missing breaks a run as one that is false does: only the true ones go on
        true = seen.select(F.concat_ws(" ", *keys).alias("metric"), F.col("_w.end").alias("ts"), F.inline(F.array_compact(F.array(*told)))).withColumn("cond", F.lit(True))
        firing = sustained(true, ["metric", "rule"], held, step).where("state = 'firing'")
        parts.append(firing.select("metric", "rule", "ts", rnd("value", 4).alias("value"), "severity"))
    return reduce(DataFrame.unionByName, parts)


# How the pipeline rules read a rate, and for how long their conditions must hold.
PIPELINE = {"span": "1 hour", "share": 0.5, "stalled": "3 minutes", "degraded": "10 minutes"}


def pipeline_rules(
    rates: DataFrame, keys: list[str], step: str = "5 minutes", span: str = PIPELINE["span"], share: float = PIPELINE["share"],
    stalled: str = PIPELINE["stalled"], degraded: str = PIPELINE["degraded"], max_rows: int | None = None,
) -> DataFrame:
    """Per bucket ok, pending or firing of two rules on ingestion rates.

    Stalled: the rate is zero. Degraded: it is above zero and below `share` of its mean over `span`. A rule fires once its
    condition has held for its time at every bucket; a missing bucket lets go of it.
    """
    mean = in_chunks(rates, keys, ["bucket"], Recent("bucket", "rate", interval_us(span), "mean_rate"), {"mean_rate": "double"}, max_rows)
    low = rnd(F.col("rate") - F.col("mean_rate") * share, 6) < 0
    told = mean.withColumns({"_stalled": F.col("rate") == 0, "_degraded": (F.col("rate") > 0) & low})
    grid = interval_us(step)
    held = Together(Held("bucket", "_stalled", grid, "_s"), Held("bucket", "_degraded", grid, "_d"))
    out = in_chunks(told, keys, ["bucket"], held, {"_s": "long", "_d": "long"}, max_rows)

    def state(since: str, hold: str) -> Column:
        firing = F.unix_micros("bucket") - F.col(since) >= interval_us(hold)
        return F.when(F.col(since) < 0, "ok").when(firing, "firing").otherwise("pending")

    return out.select(*keys, "bucket", rnd("rate", 4).alias("rate"), rnd("mean_rate", 4).alias("mean_rate"), state("_s", stalled).alias("stalled"), state("_d", degraded).alias("degraded"))


def rate_alerts(rates: DataFrame, keys: list[str], limit: float = 0.1, hold: str = "5 minutes", step: str = "5 minutes") -> DataFrame:
    """State of every bucket of `rate_over` against a limit that must be exceeded for the hold time."""
    evals = rates.select(*keys, F.col("bucket").alias("ts"), "rate", F.coalesce(F.col("rate") > limit, F.lit(False)).alias("cond"))
    return sustained(evals, keys, hold, step).select(*keys, "ts", rnd("rate", 4).alias("rate"), "state")


def interface_down(net: DataFrame, as_of: datetime | str, window: str = "2 minutes") -> DataFrame:
    """Interfaces with more DOWN than UP samples."""
    return (
        last(net, "time", window, as_of).groupBy("device_id", "iface_name")
        .agg(F.count(F.lit(1)).alias("value"), F.count_if(F.col("status") == "DOWN").alias("_d"), F.count_if(F.col("status") == "UP").alias("_u"))
        .where(F.col("_d") > F.col("_u")).drop("_d", "_u")
    )


def zscore_anomaly(sys: DataFrame, measure: str, as_of: datetime | str, base: str = "24 hours", cur: str = "5 minutes", z: float = 3.0, cur_positive: bool = False) -> DataFrame:
    """Devices whose current mean lies more than z sigmas from their base mean.

    Base (positive readings) and current window come from one scan: the current window lies inside the base window.
    """
    x = F.col(measure)
    fresh = F.col("time") > ts_lit(minus(as_of, cur))
    if cur_positive:
        fresh = fresh & (x > 0)
    stats = last(sys, "time", base, as_of).groupBy("device_id").agg(
        F.avg(F.when(x > 0, x)).alias("mu"), F.stddev_samp(F.when(x > 0, x)).alias("sigma"), F.avg(F.when(fresh, x)).alias("now")
    )
    score = F.abs(F.col("now") - F.col("mu")) / F.nullif(F.col("sigma"), F.lit(0.0))
    return stats.where((F.col("sigma") > 0) & (score > z)).select("device_id", rnd(score, 4).alias("z"))


def probe_sla(probes: DataFrame, as_of: datetime | str, window: str = "1 hour", max_error_pct: float = 0.01, max_latency: float = 2.0, min_cert_days: float = 30.0) -> DataFrame:
    """Down, slow, SLA-breach and expiring-certificate alerts per probed instance."""
    stats = last(probes, "time", window, as_of).groupBy("instance").agg(
        F.max_by(F.struct("success", "duration_s", "cert_expiry"), F.struct("time", "probe_id")).alias("now"), F.avg("success").alias("up")
    )
    days = seconds_between(F.col("now")["cert_expiry"], ts_lit(as_of)) / 86400
    error = (1 - F.col("up")) * 100

    def alert(cond: Column, name: str, value: Column) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("alertname"), value.cast("double").alias("value")))

    fired = F.array_compact(
        F.array(
            alert(F.col("now")["success"] == 0, "ServiceDown", F.col("now")["success"]),
            alert(F.col("now")["duration_s"] > max_latency, "ServiceHighLatency", F.col("now")["duration_s"]),
            alert(rnd(error, 6) > max_error_pct, "SLABreachWarning", error),
            alert(days < min_cert_days, "SSLCertExpiring", days),
        )
    )
    return stats.select("instance", F.explode(fired).alias("a")).select("instance", "a.alertname", rnd("a.value", 4).alias("value"))


# Modulus of a 64-bit counter, and the rate above which a sample is discarded.
COUNTER_MODULUS = "18446744073709551616"
MAX_MBPS = 40000.0


def _octets(direction: str) -> Column:
    """The 64-bit counter where it has counted, else the 32-bit one."""
    wide = F.coalesce(F.col(f"{direction}64"), F.lit(0))
    return F.when(wide > 0, wide).otherwise(F.coalesce(F.col(f"{direction}32"), F.lit(0))).cast("decimal(38,0)")


def with_octets(counters: DataFrame) -> DataFrame:
    """Counter rows with _rx and _tx; a table without error or drop counts gets empty ones."""
    extra = {c: F.lit(None).cast("long") for c in ("errors", "drops") if c not in counters.columns}
    return counters.withColumns({"_rx": _octets("rx"), "_tx": _octets("tx"), **extra})


def rates_between_polls(polled: DataFrame) -> DataFrame:
    """Rates of rows that carry their counters before (_prx, _ptx) and the seconds since that poll (_dt).

    A negative step wraps at 2^64. Without earlier counters, on a down interface, after half a second or less and
    beyond 40 Gb/s the rate is 0; unnamed interfaces are not reported.
    """
    up = F.col("status") == 1
    known = (F.greatest("_prx", "_ptx") > 0) & (F.col("_dt") > 0.5)

    def rate(d: str) -> Column:
        step = F.col(f"_{d}") - F.col(f"_p{d}")
        step = F.when(step < 0, step + F.lit(COUNTER_MODULUS).cast("decimal(38,0)")).otherwise(step)
        mbps = step.cast("double") * 8 / (F.col("_dt") * 1e6)
        return F.when(up & known & (mbps <= MAX_MBPS), rnd(mbps, 2)).otherwise(0.0)

    return polled.where(F.coalesce(F.col("name"), F.lit("")) != "").select(
        "device_id", F.col("name").alias("iface_name"), "ts", rate("rx").alias("rx_mbps"), rate("tx").alias("tx_mbps"),
        F.col("errors").cast("long").alias("errors"), F.col("drops").cast("long").alias("drops"), F.when(up, "UP").otherwise("DOWN").alias("status"),
    )


def counter_rate(counters: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Receive and transmit Mbps per interface from octet counters, with error and drop counts.

    The poll before is the device's last one, whatever interfaces it held; an interface that it did not hold has no
    earlier counters.
    """
    rows = with_octets(counters)

    def poll_before(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("_before", F.lag("ts").over(w))

    polls = over_rows(rows.select("device_id", "ts").distinct(), ["device_id"], ["ts"], 1, poll_before, max_rows)

    def row_before(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumns({"_last": F.lag("ts").over(w), "_prx": F.lag("_rx").over(w), "_ptx": F.lag("_tx").over(w)})

    held = over_rows(rows, ["device_id", "iface"], ["ts"], 1, row_before, max_rows).join(polls, ["device_id", "ts"])
    same = F.col("_last") == F.col("_before")
    return rates_between_polls(held.withColumns({
        "_prx": F.when(same, F.col("_prx")), "_ptx": F.when(same, F.col("_ptx")), "_dt": (F.unix_micros("ts") - F.unix_micros("_before")) / F.lit(1e6),
    }))


def rate_over(counter: DataFrame, keys: list[str], ts: str, value: str, width: str = "5 minutes", across: bool = True, max_rows: int | None = None) -> DataFrame:
    """Per-second increase of a counter, by the bucket of the later reading; a fall is a reset, after which it counts from zero.

    The first reading of a bucket counts from the last reading before it, in whatever bucket that lies; without `across`
    each bucket begins anew. Only the key's first reading has none before.
    """
    rows = counter.select(*keys, F.col(ts).alias("_ts"), time_bucket(ts, width).alias("bucket"), F.col(value).cast("double").alias("_v"))

    def step(df: DataFrame, w: WindowSpec) -> DataFrame:
        known = F.lag("_v").over(w)
        before = known if across else F.when(F.lag("bucket").over(w).eqNullSafe(F.col("bucket")), known)
        return df.withColumn("_b", before)

    risen = F.when(F.col("_b").isNull(), 0.0).when(F.col("_v") >= F.col("_b"), F.col("_v") - F.col("_b")).otherwise(F.col("_v"))
    read = over_rows(rows.where("_v IS NOT NULL"), keys, ["_ts", "_v"], 1, step, max_rows).select(*keys, "bucket", risen.alias("_step"))
    # a bucket without a known reading still has its row
    blank = rows.where("_v IS NULL").select(*keys, "bucket", F.lit(0.0).alias("_step"))
    return read.unionByName(blank).groupBy(*keys, "bucket").agg((F.sum("_step") / F.lit(interval_us(width) / 1e6)).alias("rate"))


def rate_degraded(rates: DataFrame, keys: list[str], back: int = 12, share: float = 0.5) -> DataFrame:
    """STALLED at rate 0, DEGRADED below a share of the mean of the last `back` buckets, else OK."""

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("mean_rate", F.avg("rate").over(w.rowsBetween(-(back - 1), 0)))

    out = over_rows(rates, keys, ["bucket"], back - 1, build)
    status = F.when(F.col("rate") == 0, "STALLED").when(rnd(F.col("rate") - F.col("mean_rate") * share, 6) < 0, "DEGRADED").otherwise("OK")
    return out.select(*keys, "bucket", rnd("rate", 4).alias("rate"), rnd("mean_rate", 4).alias("mean_rate"), status.alias("status"))

