"""Filters and specification flags."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeutil import interval_us, minus, ts_lit, ts_plus

# Specification limits of the process.
SPEC_LIMITS = {
    "temperature": (20.0, 24.0),
    "humidity": (50.0, 60.0),
    "air_vacuum": (-30.0, -8.0),
    "position_error": 10.0,
    "scan_speed": 450.0,
    "resist_dosage": 650.0,
}


def _outside(c: str, lo: float, hi: float) -> Column:
    return (F.col(c) < lo) | (F.col(c) > hi)


def spec_flag_columns(limits: dict = SPEC_LIMITS) -> dict[str, Column]:
    """Out-of-spec flags; NULL readings give NULL flags, except vacuum where NULL means not measured."""
    err = limits["position_error"]
    thermal = _outside("temperature", *limits["temperature"])
    humid = _outside("humidity", *limits["humidity"])
    return {
        "flag_thermal_out_of_spec": thermal,
        "flag_humidity_out_of_spec": humid,
        "flag_vac_out_of_spec": F.col("air_vacuum").isNotNull() & _outside("air_vacuum", *limits["air_vacuum"]),
        "flag_pe_out_of_spec": (F.abs("pe_1") > err) | (F.abs("je_1") > err),
        "flag_scan_speed_out_of_spec": (F.col("scan_speed") > limits["scan_speed"]) | (F.col("scan_speed") <= 0),
        "flag_exposure_out_of_spec": (F.col("resist_dosage") > limits["resist_dosage"]) | (F.col("resist_dosage") <= 0),
        "flag_temp_out_of_spec": thermal | humid,
    }


def spec_flags(df: DataFrame, limits: dict = SPEC_LIMITS) -> DataFrame:
    return df.withColumns(spec_flag_columns(limits))


def last(
    df: DataFrame,
    ts: str,
    width: str,
    as_of: datetime | str,
    inclusive: bool = False,
    date_col: str | None = None,
) -> DataFrame:
    """Rows newer than as_of - width. With a `date_col` partition column the bound prunes partitions too."""
    lo = minus(as_of, width)
    cond = F.col(ts) >= ts_lit(lo) if inclusive else F.col(ts) > ts_lit(lo)
    if date_col:
        cond = cond & (F.col(date_col) >= F.lit(lo.date()))
    return df.where(cond)


def last_of_data(df: DataFrame, ts: str, width: str) -> DataFrame:
    """Rows newer than MAX(ts) - width; the maximum is one scalar subquery."""
    newest = df.agg(F.max(ts)).scalar()
    return df.where(F.col(ts) > ts_plus(newest, -interval_us(width)))


def time_range(df: DataFrame, ts: str, lo: datetime | str, hi: datetime | str) -> DataFrame:
    return df.where(F.col(ts).between(ts_lit(lo), ts_lit(hi)))


def in_or_all(c: str, values: list | None) -> Column:
    """Membership test; no list means no filter."""
    return F.lit(True) if values is None else F.col(c).isin(list(values))


def is_distinct(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def scope_devices(df: DataFrame, devices: DataFrame, device_type: str | None = None, key: str = "device_id") -> DataFrame:
    """Keep facts of enabled registered devices (of one type)."""
    keep = devices.where(F.col("enabled"))
    if device_type is not None:
        keep = keep.where(F.col("device_type") == device_type)
    ids = keep.select(F.col("device_id").alias(key))
    return df.join(ids, key, "left_semi")
