"""Control-chart rules on ordered machine histories."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import last, max_abs, rnd
from ..schema import PE_COLS
from .recurrences import one_sided_sums, smoothed
from .series import expanding_stats, over_rows

ORDER = ["time", "log_id"]


def error_series(tele: DataFrame, pe: list[str] = PE_COLS, as_of: datetime | str | None = None, minutes: int | None = None) -> DataFrame:
    """time, eqp_id, log_id and the largest absolute error of each measured row."""
    rows = tele if as_of is None or minutes is None else last(tele, "time", f"{minutes} minutes", as_of, inclusive=True)
    return rows.where(F.col(pe[0]).isNotNull()).select("time", "eqp_id", "log_id", max_abs(pe).alias("raw_value"))


def rolling_stats(series: DataFrame, value: str, window: int = 30, max_rows: int | None = None) -> DataFrame:
    """Mean and sigma over the last `window` rows of each machine."""

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        w = w.rowsBetween(-(window - 1), 0)
        return df.withColumns({"mu": F.avg(value).over(w), "sigma": F.stddev_samp(value).over(w)})

    return over_rows(series, ["eqp_id"], ORDER, window - 1, build, max_rows)


def expanding(series: DataFrame, value: str, max_rows: int | None = None) -> DataFrame:
    """Mean and sigma over all earlier rows of each machine."""
    return expanding_stats(series, ["eqp_id"], ORDER, value, max_rows)


def ewma(tele: DataFrame, lam: float = 0.2, limit: float = 25.0, pe: list[str] = PE_COLS, as_of=None, minutes=None, max_rows: int | None = None) -> DataFrame:
    """Exponentially weighted moving average of the largest error, with fixed limits around zero."""
    band = round(limit * math.sqrt(lam / (2 - lam)), 3)
    out = smoothed(error_series(tele, pe, as_of, minutes), ["eqp_id"], ORDER, "raw_value", lam, "ewma", max_rows)
    return out.select(
        "time", "eqp_id", "log_id", rnd("raw_value", 3).alias("raw_value"), rnd("ewma", 3).alias("ewma_value"),
        F.lit(band).alias("ucl"), F.lit(-band).alias("lcl"),
    )


def cusum(
    tele: DataFrame, target: float = 0.0, k: float = 0.5, h: float = 10.0, mode: str = "recursive",
    pe: list[str] = PE_COLS, as_of=None, minutes=None, max_rows: int | None = None,
) -> DataFrame:
    """Cumulative sums of deviations above target+k and below target-k; alarm beyond h.

    mode 'recursive' accumulates; 'one_lag' adds only the previous row's excess, as the original dashboards did.
    """
    series = error_series(tele, pe, as_of, minutes)
    up, down = F.col("raw_value") - target - k, F.lit(target) - F.col("raw_value") - k
    if mode == "recursive":
        out = one_sided_sums(series, ["eqp_id"], ORDER, up, down, max_rows)
    else:
        zero = F.lit(0.0)

        def build(df: DataFrame, w: WindowSpec) -> DataFrame:
            df = df.withColumns({"_u": F.greatest(zero, up), "_d": F.greatest(zero, down)})

            def two(c: str) -> Column:
                return F.col(c) + F.coalesce(F.lag(c).over(w), zero)

            return df.withColumns({"cusum_pos": two("_u"), "cusum_neg": two("_d")}).drop("_u", "_d")

        out = over_rows(series, ["eqp_id"], ORDER, 1, build, max_rows)
    pos, neg = rnd("cusum_pos", 3), rnd("cusum_neg", 3)
    return out.select(
        "time", "eqp_id", "log_id", rnd("raw_value", 3).alias("raw_value"), pos.alias("cusum_pos"), neg.alias("cusum_neg"),
        ((pos > h) | (neg > h)).alias("alarm"),
    )


def nelson_rules(tele: DataFrame, window: int = 30, pe: list[str] = PE_COLS, max_rows: int | None = None) -> DataFrame:
    """Rule 1 beyond three sigma, rule 2 nine points on one side, rule 3 six moves in one direction.

    (machine, time, id) orders the rows; two rows of a machine at one time are two points here.
    """
    series = error_series(tele, pe)

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        recent = w.rowsBetween(-(window - 1), 0)
        df = df.withColumns({"mu": F.avg("raw_value").over(recent), "sigma": F.stddev_samp("raw_value").over(recent)})
        side = F.signum(rnd(F.col("raw_value") - F.col("mu"), 6))
        move = F.coalesce(F.signum(F.col("raw_value") - F.lag("raw_value").over(w)), F.lit(0.0))
        df = df.withColumns({"_side": side, "_move": move})
        return df.withColumns({"_s9": F.sum("_side").over(w.rowsBetween(-8, 0)), "_m6": F.sum("_move").over(w.rowsBetween(-5, 0))})

    out = over_rows(series, ["eqp_id"], ORDER, window + 8, build, max_rows)
    mu, sigma, x = F.col("mu"), F.col("sigma"), F.col("raw_value")
    beyond = (sigma > 0) & ((x > mu + 3 * sigma) | (x < mu - 3 * sigma))
    r1 = F.when(beyond, 1).otherwise(0)
    r2 = F.when(F.abs("_s9") == 9, 1).otherwise(0)
    r3 = F.when(F.abs("_m6") == 6, 1).otherwise(0)
    return out.select(
        "time", "eqp_id", "log_id", rnd(x, 4).alias("avg_pe"), rnd(mu, 4).alias("mu"), rnd(sigma, 4).alias("sigma"),
        rnd(mu + 3 * sigma, 4).alias("ucl"), rnd(mu - 3 * sigma, 4).alias("lcl"),
        r1.alias("rule1_beyond_3sigma"), r2.alias("rule2_nine_same_side"), r3.alias("rule3_six_trend"),
        F.greatest(r1, r2, r3).alias("any_rule_triggered"),
    )


def dynamic_limits(tele: DataFrame, measure: str, window: int = 30, target: float = 0.0, k: float = 0.5, h: float = 10.0, max_rows: int | None = None) -> DataFrame:
    """Moving mean with three sigma limits and a two-sided cumulative-sum flag on one measure."""
    series = tele.where(F.col(measure).isNotNull()).select("time", "eqp_id", "log_id", F.col(measure).cast("double").alias("x"))
    banded = rolling_stats(series, "x", window, max_rows)
    out = one_sided_sums(banded, ["eqp_id"], ORDER, F.col("x") - target - k, F.lit(target) - F.col("x") - k, max_rows)
    mu, sigma = F.col("mu"), F.col("sigma")
    pos, neg = rnd("cusum_pos", 3), rnd("cusum_neg", 3)
    return out.select(
        "time", "eqp_id", "log_id", rnd("x", 4).alias("x"), rnd(mu, 4).alias("centre"),
        rnd(mu + 3 * sigma, 4).alias("ucl"), rnd(mu - 3 * sigma, 4).alias("lcl"),
        F.when((pos > h) | (neg > h), 1).otherwise(0).alias("shift_flag"),
    )
