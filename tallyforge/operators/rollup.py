"""Time-bucketed rollups, their cascades, and reads that pick the right tier."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import last, max_abs, rnd, row_mean, time_bucket, ts_lit
from ..schema import JE_COLS, PE_COLS

TELEMETRY_KEYS = ["eqp_id", "factory", "process", "mo", "fpn", "layer_name"]
TELEMETRY_MEASURES = [
    "temperature", "humidity", "air_vacuum", "scan_speed", "thickness", "resist_dosage", "scale_x", "scale_y",
    *PE_COLS, *JE_COLS, "pe_setting", "je_setting",
]

# Output column -> (aggregate, input column) of the hourly infrastructure rollups.
INFRA_SPECS = {
    "sys": (
        ["device_id"],
        {
            "avg_cpu": ("avg", "cpu_load_percent"), "max_cpu": ("max", "cpu_load_percent"),
            "avg_ram_used": ("avg", "ram_used_mb"), "avg_ram_total": ("avg", "ram_total_mb"),
            "avg_disk_used": ("avg", "disk_used_gb"), "avg_disk_total": ("avg", "disk_total_gb"), "max_temp": ("max", "temp_c"),
        },
    ),
    "net": (
        ["device_id", "iface_name"],
        {
            "avg_rx": ("avg", "rx_mbps"), "max_rx": ("max", "rx_mbps"), "avg_tx": ("avg", "tx_mbps"), "max_tx": ("max", "tx_mbps"),
            "total_errors": ("sum", "rx_errors"), "total_drops": ("sum", "rx_drops"),
        },
    ),
    "ldi": (
        ["device_id"],
        {
            "avg_throughput": ("avg", "throughput"), "max_temp": ("max", "temperature"), "avg_humidity": ("avg", "humidity"),
            "avg_power": ("avg", "power_watt"), "avg_vibration": ("avg", "vibration"),
        },
    ),
}
GRAIN_WIDTH = {"hour": "1 hour", "day": "1 day", "week": "1 week"}

Spec = dict[str, tuple[str, str]]


def rollup(df: DataFrame, ts: str, width: str, keys: list[str], spec: Spec, counts: bool = True) -> DataFrame:
    """Bucketed aggregates. With `counts`, each average carries its sample count as `cnt_<name>` for exact merging."""
    aggs: list[Column] = []
    for name, (fn, col) in spec.items():
        aggs.append(getattr(F, fn)(col).alias(name))
        if counts and fn == "avg":
            aggs.append(F.count(col).alias(f"cnt_{name}"))
    return df.groupBy(time_bucket(ts, width).alias("bucket"), *keys).agg(F.count(F.lit(1)).alias("sample_count"), *aggs)


def reaggregate(df: DataFrame, width: str, keys: list[str], spec: Spec, mode: str = "weighted", counts: bool = True) -> DataFrame:
    """Coarser rollup from a finer one: SUM of sums and counts, MAX of maxima, MIN of minima.

    Averages merge by their counts ('weighted'), or as the plain mean of means ('avg_of_avg').
    """
    aggs: list[Column] = []
    for name, (fn, _) in spec.items():
        if fn != "avg":
            aggs.append(getattr(F, fn)(name).alias(name))
            continue
        weight = F.sum(f"cnt_{name}") if counts else None
        if mode == "weighted":
            aggs.append((F.sum(F.col(name) * F.col(f"cnt_{name}")) / F.nullif(weight, F.lit(0))).alias(name))
        else:
            aggs.append(F.avg(name).alias(name))
        if counts:
            aggs.append(weight.alias(f"cnt_{name}"))
    return df.groupBy(time_bucket("bucket", width).alias("bucket"), *keys).agg(F.sum("sample_count").alias("sample_count"), *aggs)


def drop_counts(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("cnt_")])


def infra_rollup(df: DataFrame, table: str, grain: str = "hour", mode: str = "avg_of_avg") -> DataFrame:
    """Hourly rollup of an infrastructure table, cascaded to days and weeks."""
    keys, spec = INFRA_SPECS[table]
    out = rollup(df, "time", "1 hour", keys, spec)
    for step in ("day", "week"):
        if grain == "hour":
            break
        out = reaggregate(out, GRAIN_WIDTH[step], keys, spec, mode)
        if grain == step:
            break
    return drop_counts(out)


def telemetry_spec(measures: list[str] = TELEMETRY_MEASURES) -> Spec:
    return {f"avg_{m}": ("avg", m) for m in measures}


def telemetry_rollup(tele: DataFrame, grain: str = "1m", mode: str = "weighted", keys: list[str] = TELEMETRY_KEYS, measures: list[str] = TELEMETRY_MEASURES) -> DataFrame:
    """1-minute averages of every measure, cascaded to 15 minutes and 1 hour."""
    spec = telemetry_spec(measures)
    out = rollup(tele, "time", "1 minute", keys, spec)
    if grain in ("15m", "1h"):
        out = reaggregate(out, "15 minutes", keys, spec, mode)
    if grain == "1h":
        out = reaggregate(out, "1 hour", keys, spec, mode)
    return drop_counts(out)


def direct_hourly(tele: DataFrame) -> DataFrame:
    """Hourly machine analytics with mean and peak of the largest present error."""
    worst = max_abs(PE_COLS, coalesce0=False)
    return tele.groupBy(time_bucket("time", "1 hour").alias("bucket"), "eqp_id").agg(
        F.avg("temperature").alias("avg_temp"), F.max("temperature").alias("max_temp"), F.avg("humidity").alias("avg_humidity"),
        F.avg(worst).alias("avg_max_pe"), F.max(worst).alias("peak_pe"), F.avg("scan_speed").alias("avg_scan_speed"),
        F.avg("air_vacuum").alias("avg_air_vacuum"), F.count(F.lit(1)).alias("sample_count"),
    )


def engineering_hourly(tele: DataFrame) -> DataFrame:
    """Rounded hourly means and extremes, row-mean error and cycle time, of rows with a measured error."""
    cycle = F.col("total_time").cast("double") / F.nullif(F.col("total_board").cast("double"), F.lit(0.0))

    def avg(c: str, digits: int) -> Column:
        return rnd(F.avg(c), digits).alias(f"avg_{c}")

    return (
        tele.where(F.col("pe_1").isNotNull())
        .groupBy(time_bucket("time", "1 hour").alias("bucket"), "eqp_id")
        .agg(
            avg("temperature", 2), avg("humidity", 2), avg("scan_speed", 1), avg("resist_dosage", 1), avg("air_vacuum", 2),
            avg("thickness", 3), rnd(F.max("temperature"), 2).alias("max_temperature"),
            rnd(F.min("temperature"), 2).alias("min_temperature"), rnd(F.max("humidity"), 2).alias("max_humidity"),
            rnd(F.min("humidity"), 2).alias("min_humidity"), rnd(F.avg(row_mean(PE_COLS)), 3).alias("avg_pe"),
            rnd(F.max(max_abs(PE_COLS)), 2).alias("max_abs_pe"), rnd(F.avg(cycle), 2).alias("avg_cycle_time"),
            F.lit(1).cast("long").alias("machine_count"),
        )
    )


def oee_partials(tele: DataFrame, width: str = "1 minute") -> DataFrame:
    """Counts that merge by SUM into availability and quality (distinct boards are per bucket)."""
    in_spec = max_abs(PE_COLS) <= F.col("pe_setting")
    return tele.groupBy(time_bucket("time", width).alias("bucket"), "eqp_id", "factory").agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if(F.col("state")).alias("running_count"),
        F.count_if(in_spec).alias("in_spec_count"), F.count_distinct("board_no").alias("board_count"),
    )


_BOARDS = ["bucket", "eqp_id", "factory", "chunk"]


def board_bitmaps(tele: DataFrame, width: str = "1 minute") -> DataFrame:
    """The boards of each bucket and machine as bitmaps, one row for each range of 32,768 board numbers that occur.

    Counts of distinct boards do not add up from minutes to hours; bitmaps unite. Rows without a board have no bit.
    """
    rows = tele.where(F.col("board_no").isNotNull()).select(time_bucket("time", width).alias("bucket"), "eqp_id", "factory", F.col("board_no").cast("long").alias("b"))
    chunk = F.bitmap_bucket_number("b").alias("chunk")
    return rows.groupBy("bucket", "eqp_id", "factory", chunk).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("boards"))


def wider_bitmaps(tier: DataFrame, width: str) -> DataFrame:
    """`board_bitmaps` of a wider bucket from a narrower tier."""
    wide = tier.withColumn("bucket", time_bucket("bucket", width))
    return wide.groupBy(*_BOARDS).agg(F.bitmap_or_agg("boards").alias("boards"))


def distinct_boards(tier: DataFrame) -> DataFrame:
    """(bucket, eqp_id, factory, board_count): how many different boards a bucket has seen."""
    return tier.groupBy("bucket", "eqp_id", "factory").agg(F.sum(F.bitmap_count("boards")).alias("board_count"))


# Configuration assumed for machines without their own row.
DEFAULT_CONFIG = {"ideal_cycle_sec": 30.0, "downtime_cost_per_min": 250.0, "scrap_cost_per_board": 150.0}


def oee(partials: DataFrame, config: DataFrame, bucket_minutes: float = 1.0) -> DataFrame:
    """Availability, quality, performance and cost of poor quality per machine.

    Observed minutes are the buckets with data; performance is ideal board time over running time, at most 1.
    """
    per = partials.groupBy("eqp_id").agg(
        F.sum("sample_count").alias("n"), F.sum("running_count").alias("up"), F.sum("in_spec_count").alias("good"),
        F.sum("board_count").alias("boards"), (F.count(F.lit(1)) * bucket_minutes).alias("minutes"),
    )
    rows = per.join(config, "eqp_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULT_CONFIG.items()})
    a, q = F.col("up") / F.col("n"), F.col("good") / F.col("n")
    p = F.least(F.lit(1.0), F.col("boards") * F.col("ideal_cycle_sec") / F.nullif(F.col("minutes") * a * 60, F.lit(0.0)))
    copq = F.col("minutes") * (1 - a) * F.col("downtime_cost_per_min") + F.col("boards") * (1 - q) * F.col("scrap_cost_per_board")
    return rows.select(
        "eqp_id", rnd(a, 4).alias("availability"), rnd(p, 4).alias("performance"), rnd(q, 4).alias("quality"),
        rnd(a * F.coalesce(p, F.lit(0.0)) * q, 4).alias("oee"), rnd(copq, 2).alias("copq"),
    )


def legacy_oee(df: DataFrame, as_of: datetime | str, window: str = "5 minutes", day: str = "1 day") -> DataFrame:
    """Panel maths of the retired dashboard: newest row for the ratios, daily means for the loss."""

    newest = (
        last(df, "time", window, as_of).groupBy("machine_id")
        .agg(F.max_by(F.struct("throughput", "uptime", "pe", "je"), F.struct("time", "row_id")).alias("r"))
        .select("machine_id", "r.*")
    )
    defect = F.col("pe") + F.col("je")
    up = F.col("uptime") > 0
    ratio = F.col("throughput") / F.nullif(F.col("uptime"), F.lit(0.0))
    now = newest.select(
        "machine_id",
        F.when(up, rnd(ratio * (1 - defect / 200) * 100, 1)).otherwise(0.0).alias("oee"),
        F.when(up, rnd(F.col("uptime") / 86400 * 100, 1)).otherwise(100.0).alias("availability"),
        F.when(up, rnd(ratio * 100, 1)).otherwise(0.0).alias("performance"),
        F.when(defect > 0, rnd(100 - defect / 2, 1)).otherwise(100.0).alias("quality"),
    )
    daily = last(df, "time", day, as_of).groupBy("machine_id").agg(
        F.avg("pe").alias("p"), F.avg("je").alias("j"), F.avg("throughput").alias("t"), F.avg("uptime").alias("u")
    )
    loss = F.when(F.col("u") > 0, rnd((F.col("p") + F.col("j")) / 200 * F.col("t") * 86400 * 250, 0)).otherwise(0.0)
    return now.join(daily.select("machine_id", loss.alias("daily_loss")), "machine_id")


def tier_for(lo: datetime | str, hi: datetime | str) -> str:
    """Rollup tier of a range: '1m' up to six hours, '15m' up to two days, else '1h'."""
    as_dt = [x if isinstance(x, datetime) else datetime.fromisoformat(x) for x in (lo, hi)]
    hours = (as_dt[1] - as_dt[0]).total_seconds() / 3600
    return "1m" if hours <= 6 else "15m" if hours <= 48 else "1h"


def read_tier(tiers: dict[str, DataFrame], lo: datetime | str, hi: datetime | str, ts: str = "bucket") -> DataFrame:
    """The tier that fits the range, restricted to it; the bound prunes partitions of a partitioned tier."""

    return tiers[tier_for(lo, hi)].where(F.col(ts).between(ts_lit(lo), ts_lit(hi)))
