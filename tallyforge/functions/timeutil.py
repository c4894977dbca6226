"""Time arithmetic on UTC timestamps."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_US = {
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 7 * 86_400_000_000,
}


def interval_us(text: str) -> int:
    """Microseconds of an interval such as '15 minutes'."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", text.lower())
    if not m or m.group(2) not in _UNIT_US:
        raise ValueError(f"not a fixed interval: {text!r}")
    return int(m.group(1)) * _UNIT_US[m.group(2)]


def _as_datetime(t: datetime | str) -> datetime:
    return t if isinstance(t, datetime) else datetime.fromisoformat(t)


def ts_lit(t: datetime | str) -> Column:
    """Timestamp literal; foldable, so comparisons with it reach the Parquet scan."""
    return F.lit(_as_datetime(t).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def minus(t: datetime | str, width: str) -> datetime:
    return _as_datetime(t) - timedelta(microseconds=interval_us(width))


def ts_plus(ts: Column | str, us: Column | int) -> Column:
    """ts shifted by a number of microseconds."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_micros(F.unix_micros(ts) + us)


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since the epoch with the fraction kept."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts) / F.lit(1e6)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


# Weeks start on Monday; the epoch was a Thursday.
_MONDAY_US = 4 * 86_400_000_000


def time_bucket(ts: Column | str, width: str, origin_us: int | None = None) -> Column:
    """Start of the bucket of the given width that holds ts."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    w = interval_us(width)
    if origin_us is None:
        origin_us = _MONDAY_US if w % _UNIT_US["week"] == 0 else 0
    us = F.unix_micros(ts)
    return F.timestamp_micros(us - F.pmod(us - F.lit(origin_us), F.lit(w)))


def date_bin(stride: str, ts: Column | str, origin: datetime | str) -> Column:
    """Bucket start aligned to an arbitrary origin."""
    o = _as_datetime(origin)
    origin_us = int((o - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    return time_bucket(ts, stride, origin_us)
