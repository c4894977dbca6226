"""Alarm context, alarm categories, and the lift of out-of-spec conditions around alarms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import SPEC_LIMITS, interval_us, last, pct, quality_impact, rnd, spec_flag_columns, spec_flags, ts_lit, ts_plus
from .joins import asof_exact_or_backward

_CONTEXT_COLS = [
    "temperature", "humidity", "air_vacuum", "scan_speed", "resist_dosage", "pe_1", "je_1", "mo", "board_no", "total_board",
]

# Alarm codes with a known cause, and the telemetry columns that show it.
CATEGORY_CODES = {
    "VACUUM": ["91009"],
    "REGISTRATION": ["90005"],
    "ALIGNMENT": ["90001", "90004", "90012"],
    "CALIBRATION": ["93004"],
    "ENVIRONMENT": ["91008"],
    "MOTION": ["70004"],
    "OPTICS": ["10006"],
    "SAFETY": ["01180016", "0C020014"],
    "COMMUNICATION": ["0106000C", "01060013", "0106001C", "01100001", "01130002", "80001", "92013", "97005"],
    "CONFIGURATION": ["01060009", "010E0064"],
}
CATEGORY_COLUMNS = {
    "VACUUM": "air_vacuum",
    "REGISTRATION": "pe_1..pe_6, je_1..je_4",
    "ALIGNMENT": "scale_x, scale_y, pe_1..pe_6",
    "ENVIRONMENT": "temperature, humidity",
    "MOTION": "scan_speed",
}
# Report lines, the alarm categories they count, and the flag they test.
LIFT_LINES = [
    ("THERMAL (91008)", ["ENVIRONMENT"], "flag_thermal_out_of_spec"),
    ("HUMIDITY (91008)", ["ENVIRONMENT"], "flag_humidity_out_of_spec"),
    ("VACUUM (91009)", ["VACUUM"], "flag_vac_out_of_spec"),
    ("ALIGNMENT/PE-JE (90001,90004,90005,90012,90013)", ["REGISTRATION", "ALIGNMENT"], "flag_pe_out_of_spec"),
    ("MOTION (70004)", ["MOTION"], "flag_scan_speed_out_of_spec"),
]


def alarm_context(alarms: DataFrame, catalog: DataFrame, tele: DataFrame, limits: dict = SPEC_LIMITS, back: str = "5 minutes", prune: bool = True) -> DataFrame:
    """Each alarm with the telemetry behind it, spec flags, message and severity (catalog joined on alarm_id)."""
    take = {c: c for c in _CONTEXT_COLS} | {"tele_process": "process"}
    matched = asof_exact_or_backward(alarms, tele, take, back=back, prune=prune)
    codes = catalog.select(F.col("alarm_id").alias("errorcode"), "alarm_msg", "alarm_detail", "severity")
    flagged = spec_flags(matched, limits).join(codes, "errorcode", "left")
    return flagged.select(
        F.col("logdate").alias("alarm_time"), F.col("equipmentid").alias("eqp_id"), "errorcode", "alarm_msg",
        "temperature", "humidity", "air_vacuum", "scan_speed", "resist_dosage", "pe_1", "je_1",
        *spec_flag_columns(limits), "match_type", "severity", F.col("tele_process").alias("process"), "mo",
        "board_no", "total_board", "link_basis", F.col("logid").alias("alarm_id"), "related_log_id", "alarm_detail",
    )


def recent_context(alarms: DataFrame, catalog: DataFrame, tele: DataFrame, as_of: datetime | str, window: str, limits: dict = SPEC_LIMITS, back: str = "5 minutes") -> DataFrame:
    """The context of the alarms of the last `window`: the bound reaches both scans before anything is joined."""
    reach = max(interval_us("10 minutes"), interval_us(back))
    recent = last(alarms, "logdate", window, as_of)
    lower = ts_plus(ts_lit(as_of), -(interval_us(window) + reach))
    return alarm_context(recent, catalog, tele.where(F.col("time") >= lower), limits, back)


def category_column(code: Column, codes: dict[str, list[str]] = CATEGORY_CODES) -> Column:
    """Category of an alarm code from the fixed code list."""
    out = F.lit("UNCLASSIFIED")
    for category, members in codes.items():
        out = F.when(code.isin(members), category).otherwise(out)
    return out


def alarm_category(catalog: DataFrame, codes: dict[str, list[str]] = CATEGORY_CODES) -> DataFrame:
    """alarm_code, category, related telemetry columns."""
    category = category_column(F.col("alarm_code"), codes)
    related = F.lit(None).cast("string")
    for name, cols in CATEGORY_COLUMNS.items():
        related = F.when(F.col("category") == name, cols).otherwise(related)
    return catalog.select("alarm_code", category.alias("category")).withColumn("related_columns", related)


def rca_lift(
    context: DataFrame, category: DataFrame, tele: DataFrame, as_of: datetime | str | None = None,
    window: str | None = "24 hours", limits: dict = SPEC_LIMITS, min_n: int = 30,
) -> DataFrame:
    """Out-of-spec share around alarms divided by the share in all telemetry, per report line.

    Ratios use unrounded shares; a zero baseline or a line without alarms gives NULL.
    """
    if window is not None:
        context = last(context, "alarm_time", window, as_of)
        tele = last(tele, "time", window, as_of)
    lines = context.sparkSession.createDataFrame([(name,) for name, _, _ in LIFT_LINES], "alarm_category string")

    hits = context.join(category.select(F.col("alarm_code").alias("errorcode"), "category"), "errorcode")
    per_line = F.array(
        *[F.when(F.col("category").isin(cats), F.struct(F.lit(name).alias("alarm_category"), F.col(flag).alias("hit"))) for name, cats, flag in LIFT_LINES]
    )
    counted = (
        hits.select(F.explode(per_line).alias("l")).where(F.col("l").isNotNull()).select("l.*")
        .groupBy("alarm_category")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
    )
    flags = spec_flag_columns(limits)
    base = tele.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(flags[f]).alias(f) for _, _, f in LIFT_LINES])
    rows = F.array(*[F.struct(F.lit(name).alias("alarm_category"), pct(F.col(flag), F.col("_all")).alias("base")) for name, _, flag in LIFT_LINES])
    baseline = base.select(F.explode(rows).alias("b")).select("b.*")

    n = F.coalesce(F.col("n"), F.lit(0))
    share = pct(F.col("hits"), F.col("n"))
    return (
        lines.join(counted, "alarm_category", "left").join(baseline, "alarm_category", "left")
        .select(
            "alarm_category", rnd(share, 1).alias("alarm_window_pct"), rnd("base", 1).alias("baseline_pct"),
            rnd(share / F.nullif(F.col("base"), F.lit(0.0)), 2).alias("lift"), n.alias("event_count"),
            F.when(n < min_n, f"LOW SAMPLE (n<{min_n})").otherwise("OK").alias("confidence"),
        )
    )


def flag_matrix(context: DataFrame) -> DataFrame:
    """Share of alarms with each condition out of spec, per code."""
    def share(flag: str) -> Column:
        return rnd(pct(F.count_if(flag), F.count(F.lit(1))), 1)

    return context.groupBy("errorcode").agg(
        F.count(F.lit(1)).alias("n"), share("flag_pe_out_of_spec").alias("pct_pe_oos"),
        share("flag_vac_out_of_spec").alias("pct_vac_oos"), share("flag_temp_out_of_spec").alias("pct_env_oos"),
    )


def out_of_spec_rates(tele: DataFrame, limits: dict = SPEC_LIMITS) -> DataFrame:
    """Share of telemetry rows out of spec: vacuum, environment, position error."""
    flags = spec_flag_columns(limits)
    total = F.count(F.lit(1))
    return tele.agg(
        rnd(pct(F.count_if(flags["flag_vac_out_of_spec"]), total), 2).alias("pct_vac_oos"),
        rnd(pct(F.count_if(flags["flag_temp_out_of_spec"]), total), 2).alias("pct_env_oos"),
        rnd(pct(F.count_if(flags["flag_pe_out_of_spec"]), total), 2).alias("pct_pe_oos"),
    )


def with_quality_impact(context: DataFrame) -> DataFrame:
    return context.withColumn("quality_impact", quality_impact())


def board_trace(tele: DataFrame, k: int = 200) -> DataFrame:
    """Last k boards with their job, position and first violated spec."""
    cols = ["time", "eqp_id", "mo", "fpn", "layer_name", "board_no", "total_board", "board_id", "log_id"]
    return spec_flags(tele).withColumn("quality_impact", quality_impact()).select(*cols, "quality_impact").orderBy(
        F.desc("time"), F.desc("log_id")
    ).limit(k)
