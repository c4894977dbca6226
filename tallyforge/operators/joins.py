"""Joins: dimension joins, as-of joins, latest row per key.

As-of joins never pair rows. Both sides are put into one (key, time bucket) group, ordered by time, and each left row
takes the last right row seen before it (and, for the nearest match, the first one after it). A right row is copied
into a neighbouring bucket only when a left row there could still reach it, so a hot key is spread over its buckets
and the work stays linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeutil import interval_us, ts_plus

_BUCKET_FACTOR = 16


def join_dim(fact: DataFrame, dim: DataFrame, key: str | list[str]) -> DataFrame:
    """Inner join fact -> dimension. The strategy is left to the optimizer, which knows the dimension's size."""
    return fact.join(dim, key, "inner")


def join_catalog(alarms: DataFrame, catalog: DataFrame, on: str = "alarm_code") -> DataFrame:
    """Left join alarm -> code catalog on the code (or on the id)."""
    cat = catalog.withColumnRenamed(on, "errorcode")
    return alarms.join(cat, "errorcode", "left")


def registry_left(devices: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Keep every registered device, with or without statistics."""
    return devices.join(stats, key, "left")


def full_outer_coalesce(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join whose keys come from whichever side has the row."""
    return left.join(right, keys, "outer")


def semi(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_semi")


def orphans(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `left` without a partner."""
    return left.join(right.select(*keys), keys, "left_anti")


def with_scalar(df: DataFrame, one_row: DataFrame, cols: list[str]) -> DataFrame:
    """Attach the values of a one-row aggregate as scalar subqueries (no cross join)."""
    return df.withColumns({c: one_row.select(c).scalar() for c in cols})


def bounded_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, before: str, after: str, how: str = "left") -> DataFrame:
    """Equi join with right_ts BETWEEN left_ts - before AND left_ts + after. Key columns must carry the same names."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = [left[k] == r[f"_r_{k}"] for k in keys]
    near = r[right_ts].between(ts_plus(left[left_ts], -interval_us(before)), ts_plus(left[left_ts], interval_us(after)))
    return left.join(r, [*cond, near], how).drop(*[f"_r_{k}" for k in keys])


def latest_per_key(df: DataFrame, keys: list[str], ts: str, tie: str | None = None) -> DataFrame:
    """Newest row per key: the newest time by hash aggregation over two narrow columns, then the rows of that time.

    Only rows that share a key's newest time are ordered, by `tie`. Rows without a time come last, keys may be NULL.
    """
    newest = df.groupBy(*keys).agg(F.max(ts).alias("_t")).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [df[k].eqNullSafe(newest[f"_k_{k}"]) for k in keys]
    found = df.join(newest, [*same, df[ts].eqNullSafe(newest["_t"])]).select(*[df[c] for c in df.columns])
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(tie) if tie else F.lit(0))
    return found.withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn")


def join_on_device(left: DataFrame, right: DataFrame, key: str, left_order: list[Column], right_order: list[Column], k: int = 100) -> DataFrame:
    """First k rows per device of `left` LEFT JOIN `right` on the device, ordered by left, then right.

    Only the first k rows of either side can take part, so each side is cut to k per device before the join (the cut
    runs ahead of the shuffle) and a device never yields all its pairs.
    """
    def first(df: DataFrame, order: list[Column], name: str) -> DataFrame:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(name) <= k)

    both = first(left, left_order, "_l").join(first(right, right_order, "_r"), key, "left")
    return first(both, [F.col("_l"), F.col("_r")], "_n").drop("_l", "_r", "_n")


def _asof(
    left: DataFrame,
    right: DataFrame,
    by: str,
    ts: str,
    tolerance: str,
    right_by: str,
    right_ts: str,
    right_id: str,
    take: dict[str, str],
    nearest: bool,
    prune: bool,
) -> DataFrame:
    tol = interval_us(tolerance)
    width = tol * _BUCKET_FACTOR

    def bucket(us: Column) -> Column:
        return F.floor(us / F.lit(width))

    us = F.unix_micros(F.col(right_ts))
    homes = F.sequence(bucket(us - tol) if nearest else bucket(us), bucket(us + tol))
    r = right.where(F.col(right_by).isNotNull()).select(
        F.col(right_by).alias("_k"),
        F.col(right_ts).alias("_t"),
        F.col(right_id).alias("_tie"),
        F.lit(0).alias("_side"),
        F.struct(F.col(right_ts).alias("_t"), *[F.col(c).alias(n) for n, c in take.items()]).alias("_r"),
        F.explode(homes).alias("_b"),
    )
    # rows without a key match nothing; spread them instead of letting them meet in one group
    own = bucket(F.unix_micros(F.col(ts)))
    spread = -1 - F.pmod(F.xxhash64(F.col(ts)), F.lit(65536))
    lhs = left.withColumns(
        {
            "_k": F.col(by),
            "_t": F.col(ts),
            "_side": F.lit(1),
            "_b": F.when(F.col(by).isNull(), spread).otherwise(own).cast("bigint"),
        }
    )
    if prune:
        r = r.join(lhs.select("_k", "_b").distinct(), ["_k", "_b"], "left_semi")
    both = lhs.unionByName(r, allowMissingColumns=True)
    group = Window.partitionBy("_k", "_b")
    seen = group.orderBy("_t", "_side", F.desc("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_prev", F.last("_r", ignorenulls=True).over(seen))
    if nearest:
        ahead = group.orderBy(F.desc("_t"), F.desc("_side"), F.desc("_tie")).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("_next", F.last("_r", ignorenulls=True).over(ahead))
    out = out.where(F.col("_side") == 1)

    def gap(c: str) -> Column:
        return F.abs(F.unix_micros(F.col(c)["_t"]) - F.unix_micros(F.col("_t")))

    best = F.when(gap("_prev") <= tol, F.col("_prev"))
    if nearest:
        following = F.when(gap("_next") <= tol, F.col("_next"))
        closer = gap("_next") < F.coalesce(gap("_prev"), F.lit(tol + 1))
        best = F.when(closer & following.isNotNull(), following).otherwise(best)
    out = out.withColumn("_m", best)
    return out.select(*left.columns, *[F.col("_m")[n].alias(n) for n in take])


def asof_backward(
    left: DataFrame, right: DataFrame, by: str, ts: str, tolerance: str, take: dict[str, str], *,
    right_by: str | None = None, right_ts: str | None = None, right_id: str = "log_id", prune: bool = False,
) -> DataFrame:
    """Latest right row at or before each left row, at most `tolerance` old.

    `take` maps output names to right columns. `prune` first drops right rows whose (key, bucket) no left row needs:
    worth it when the left side is small against the right one.
    """
    return _asof(left, right, by, ts, tolerance, right_by or by, right_ts or ts, right_id, take, False, prune)


def asof_nearest(
    left: DataFrame, right: DataFrame, by: str, ts: str, tolerance: str, take: dict[str, str], *,
    right_by: str | None = None, right_ts: str | None = None, right_id: str = "log_id", prune: bool = False,
) -> DataFrame:
    """Right row closest in time on either side; ties go to the earlier row, then to the smaller id."""
    return _asof(left, right, by, ts, tolerance, right_by or by, right_ts or ts, right_id, take, True, prune)


def asof_exact_or_backward(
    alarms: DataFrame, tele: DataFrame, take: dict[str, str], *, exact_before: str = "10 minutes",
    exact_after: str = "1 minute", back: str = "5 minutes", prune: bool = True,
) -> DataFrame:
    """Linked telemetry row by id inside a time bound, else (only without an id) the last row of the machine.

    Adds `match_type` 'exact' / 'nearest' / NULL. An id that points outside the bound does not fall back.
    """
    named = F.col("related_log_id").isNotNull()
    reach, near = interval_us(exact_before) + interval_us(exact_after), interval_us(back)
    # both kinds of search are one as-of step: an alarm asks for a row by its id or for its machine, and each telemetry
    # row offers itself under both keys
    asks = alarms.withColumns({
        "_key": F.when(named, F.concat(F.lit("i"), "related_log_id")).otherwise(F.concat(F.lit("m"), "equipmentid")),
        "_at": F.when(named, ts_plus("logdate", interval_us(exact_after))).otherwise(F.col("logdate")),
    })
    keys = F.array(F.concat(F.lit("i"), "log_id"), F.concat(F.lit("m"), "eqp_id"))
    offers = tele.select(*dict.fromkeys(["time", "log_id", *take.values()]), F.explode(keys).alias("_key"))
    widest = f"{-(-max(reach, near) // 1_000_000)} seconds"
    found = asof_backward(asks, offers, "_key", "_at", widest, {**take, "_hit": "log_id", "_when": "time"}, right_ts="time", prune=prune)
    gap = F.unix_micros("_at") - F.unix_micros("_when")
    good = F.col("_hit").isNotNull() & (gap <= F.when(named, reach).otherwise(near))
    out = found.withColumns({n: F.when(good, F.col(n)) for n in take})
    return out.withColumn("match_type", F.when(good, F.when(named, "exact").otherwise("nearest"))).drop("_key", "_at", "_hit", "_when")
