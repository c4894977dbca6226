"""Numeric column expressions. All are built-in expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column | str, digits: int) -> Column:
    """Round half away from zero on the decimal value, so that summation noise cannot flip a tie.

    From 1e15 on a double has no digits left to round, and NaN has none: both stay as they are.
    """
    x = _col(c).cast("double")
    small = F.when(F.abs(x) < 1e15, x)
    return F.coalesce(F.round(small.cast("decimal(38,10)"), digits).cast("double"), x)


def pg_int(c: Column | str) -> Column:
    """Cast to integer by rounding (a plain Spark cast truncates)."""
    return rnd(c, 0).cast("int")


def pct(x: Column | str, y: Column | str) -> Column:
    """x / y * 100, NULL when y is zero."""
    return _col(x) / F.nullif(_col(y), F.lit(0)) * 100


def max_abs(cols: list[str], coalesce0: bool = True) -> Column:
    """Largest absolute value across repeated columns; NULL counts as 0, or is skipped."""
    terms = [F.abs(F.coalesce(F.col(c), F.lit(0.0)) if coalesce0 else F.col(c)) for c in cols]
    return F.greatest(*terms) if len(terms) > 1 else terms[0]


def range_abs(cols: list[str]) -> Column:
    """Largest minus smallest of the present values."""
    return F.greatest(*cols) - F.least(*cols)


def row_mean(cols: list[str]) -> Column:
    """Mean of the present values of one row."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])
    present = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols])
    return total / F.nullif(present, F.lit(0))


def health_score(cpu: Column, ram_pct: Column, disk_pct: Column) -> Column:
    """100 minus piecewise penalties above 70 % CPU, 75 % RAM and 80 % disk; never below 0."""
    zero = F.lit(0.0)
    return F.greatest(
        zero,
        F.lit(100.0)
        - F.greatest(zero, cpu - 70) * 1.5
        - F.greatest(zero, ram_pct - 75) * 2
        - F.greatest(zero, disk_pct - 80) * 2,
    )


# Physical ranges outside which a reading is discarded.
PHYSICAL_BOUNDS = {
    "temperature": (-40.0, 150.0),
    "percent": (0.0, 100.0),
    "mbps": (0.0, 100000.0),
    "position_error": (-100.0, 100.0),
}


def within_bounds(c: Column | str, lo: float, hi: float) -> Column:
    """The value as double if it parses and lies in [lo, hi], else NULL."""
    v = F.expr(f"try_cast(`{c}` as double)") if isinstance(c, str) else c
    return F.when(v.between(lo, hi), v)


def validate_bounds(df: DataFrame, bounds: dict[str, str | tuple[float, float]]) -> DataFrame:
    """Replace out-of-range and non-numeric readings by NULL; `bounds` maps column -> kind or (lo, hi)."""
    out = {}
    for c, b in bounds.items():
        lo, hi = PHYSICAL_BOUNDS[b] if isinstance(b, str) else b
        out[c] = within_bounds(c, lo, hi)
    return df.withColumns(out)


def clamp(c: Column | str, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; a missing value counts as 0 before clamping."""
    v = F.coalesce(_col(c).cast("double"), F.lit(0.0))
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v))


# Divisors of the supported conversions.
UNIT_DIVISOR = {"KB": 1024.0, "MB": 1048576.0, "GB": 1073741824.0, "TB": 1099511627776.0}


def convert_units(c: Column | str, unit: str) -> Column:
    """Bytes to KB/MB/GB/TB, or bytes per second to Mbps, at two decimals."""
    if unit == "Mbps":
        return rnd(_col(c) * 8 / 1e6, 2)
    return rnd(_col(c) / UNIT_DIVISOR[unit], 2)
