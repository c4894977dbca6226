"""Aggregations beyond the plain groupBy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regression(df: DataFrame, keys: list[str], y: Column, x: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(y).alias("n")
    )


def first_by(value: Column | str, order: list[Column]) -> Column:
    """Value of the first row of the group in the given order."""
    return F.min_by(value, F.struct(*order))


def duplicate_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys and surplus rows, from one pre-aggregation on the keys."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = F.coalesce(F.sum("_n"), F.lit(0)).cast("long")
    groups = F.count(F.lit(1))
    return per_key.agg(total.alias("total_rows"), groups.alias("distinct_keys"), (total - groups).alias("duplicates"))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Interpolated percentiles without holding a group in memory.

    Values are counted per distinct value first (map-side), then per logarithmic bin. Running totals over the few bins
    tell which bins hold the wanted ranks; only their values are ordered. `probs` maps output names to probabilities.
    """
    v = F.col(value).cast("double")
    # NaN sorts after all numbers, in a bin of its own
    bin_ = F.when(F.isnan(v), F.lit(1 << 62)).otherwise(F.least(F.floor(F.signum(v) * F.log1p(F.abs(v)) * 512), F.lit(1 << 61)))
    counted = (
        df.where(F.col(value).isNotNull())
        .select(*keys, v.alias("_v"), bin_.alias("_bin"))
        .groupBy(*keys, "_bin", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    bins = counted.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n"))
    up_to = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    last = F.sum("_n").over(whole) - 1
    ranked = bins.select(*keys, "_bin", (F.sum("_n").over(up_to) - F.col("_n")).alias("_lo"), F.sum("_n").over(up_to).alias("_hi"), last.alias("_last"))

    def ranks(p: float) -> tuple[Column, Column]:
        r = F.lit(p) * F.col("_last")
        return F.floor(r), F.ceil(r)

    wanted = [r for p in probs.values() for r in ranks(p)]
    needed = F.lit(False)
    for r in wanted:
        needed = needed | ((r >= F.col("_lo")) & (r < F.col("_hi")))
    chosen = ranked.where(needed).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_kb"), "_lo", "_last")
    same = [counted[k].eqNullSafe(chosen[f"_k{i}"]) for i, k in enumerate(keys)]
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = counted.join(chosen, [*same, counted["_bin"] == chosen["_kb"]]).select(
        *keys, "_v", "_last",
        (F.col("_lo") + F.sum("_n").over(inside) - F.col("_n")).alias("_from"),
        (F.col("_lo") + F.sum("_n").over(inside)).alias("_to"),
    )
    picks, out = [], []
    for i, (name, p) in enumerate(probs.items()):
        for side, r in zip("lh", ranks(p)):
            picks.append(F.max(F.when((r >= F.col("_from")) & (r < F.col("_to")), F.col("_v"))).alias(f"_{side}{i}"))
        frac = F.lit(p) * F.col("_last") - F.floor(F.lit(p) * F.col("_last"))
        between = F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * frac
        out.append(F.when(frac == 0, F.col(f"_l{i}")).otherwise(between).alias(name))
    return values.groupBy(*keys).agg(F.max("_last").alias("_last"), *picks).select(*keys, (F.col("_last") + 1).alias("n"), *out)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First k rows of an order; runs as per-task top-k and one merge."""
    return df.orderBy(*order).limit(k)


def union_events(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def with_fallback_row(df: DataFrame, fallback: DataFrame) -> DataFrame:
    """df, or the fallback row when df is empty."""
    found = df.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.unionByName(fallback.where(found == 0), allowMissingColumns=True)


def distinct_values(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    """Picker values, restricted by earlier picks; one NULL row when there are none."""
    src = df if where is None else df.where(where)
    found = src.select(F.col(col).alias("value")).distinct()
    blank = df.sparkSession.range(1).select(F.lit(None).cast(df.schema[col].dataType).alias("value"))
    return with_fallback_row(found, blank)
