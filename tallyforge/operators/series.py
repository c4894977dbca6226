"""Ordered computations per key that survive a hot key.

A window partitioned by machine puts one machine's whole history into one task. Here every history is cut into chunks of
`max_rows` consecutive rows at most, whatever its size:

* rows are counted per (key, time slice); a running total over the slices gives every row its position in the key's
  history without sorting that history in one place;
* position // max_rows is the chunk. Frames of a fixed number of rows get the last rows of the previous chunk as a
  halo; running totals get the totals of the earlier chunks as a carry.

(key, order) must be unique for reproducible output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.timeutil import interval_us

DEFAULT_MAX_ROWS = 4_000_000
_CHUNK, _POS, _GROUP = "_chunk", "_pos", "_group"


def number_rows(df: DataFrame, keys: list[str], order: list[str], slice_width: str = "1 hour") -> DataFrame:
    """Add `_pos`, the 0-based position of each row in its key's history. order[0] must be the timestamp."""
    width = interval_us(slice_width)
    sliced = df.withColumn("_slice", F.floor(F.unix_micros(order[0]) / F.lit(width)))
    per_slice = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # a struct is never NULL, so rows without a key join too, and the rank and the join share one shuffle
    group = F.struct(*keys, "_slice").alias(_GROUP)
    offsets = per_slice.select(group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(_GROUP).orderBy(*order)
    return (
        sliced.withColumn(_GROUP, group)
        .withColumn("_rank", F.row_number().over(inside))
        .join(offsets, _GROUP)
        .withColumn(_POS, F.col("_before") + F.col("_rank") - 1)
        .drop("_slice", "_before", "_rank", _GROUP)
    )


@dataclass(frozen=True)
class Layout:
    """Rows with their position, chunk and group (key and chunk)."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    size: int

    def window(self) -> WindowSpec:
        return Window.partitionBy(_GROUP).orderBy(*self.order)


def lay_out(df: DataFrame, keys: list[str], order: list[str], max_rows: int | None = None) -> Layout:
    size = max_rows or DEFAULT_MAX_ROWS
    chunked = number_rows(df, keys, order).withColumn(_CHUNK, F.floor(F.col(_POS) / size)).withColumn(_GROUP, F.struct(*keys, _CHUNK))
    return Layout(chunked, keys, order, size)


def over_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    back: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    max_rows: int | None = None,
) -> DataFrame:
    """Apply `build(df, window)`, whose frames look back at most `back` rows in total."""
    lay = lay_out(df, keys, order, max(max_rows, back + 1) if max_rows else None)
    near_end = F.pmod(F.col(_POS), F.lit(lay.size)) >= lay.size - back
    homes = F.when(near_end, F.array(F.col(_CHUNK), F.col(_CHUNK) + 1)).otherwise(F.array(F.col(_CHUNK)))
    haloed = lay.df.withColumn("_part", F.explode(homes))
    out = build(haloed, Window.partitionBy(*keys, "_part").orderBy(*order))
    return out.where(F.col("_part") == F.col(_CHUNK)).drop("_part", _CHUNK, _POS, _GROUP)


def _before(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def with_carry(lay: Layout, local: DataFrame, totals: dict[str, Column], carry: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Join each row with what the earlier chunks of its key add up to.

    `totals` aggregates a chunk; `carry` turns the chunk table (keys, _chunk, totals) into (keys, _chunk, carries).
    """
    chunks = local.groupBy(*lay.keys, _CHUNK).agg(*[c.alias(n) for n, c in totals.items()])
    return _join_carry(lay.keys, local, carry(chunks))


def _join_carry(keys: list[str], local: DataFrame, carry: DataFrame) -> DataFrame:
    extra = [c for c in carry.columns if c not in (*keys, _CHUNK)]
    return local.join(carry.select(F.struct(*keys, _CHUNK).alias(_GROUP), *extra), _GROUP).drop(_GROUP)


def row_positions(df: DataFrame, keys: list[str], order: list[str], slice_width: str = "1 hour") -> DataFrame:
    """1-based `row_no` per key."""
    return number_rows(df, keys, order, slice_width).withColumn("row_no", (F.col(_POS) + 1).cast("int")).drop(_POS)


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], max_rows: int | None = None) -> DataFrame:
    """Running totals (current row included) per key."""
    lay = lay_out(df, keys, order, max_rows)
    to_here = lay.window().rowsBetween(Window.unboundedPreceding, 0)
    src = lay.df.withColumns({f"_x_{n}": c for n, c in sums.items()})
    local = src.withColumns({n: F.sum(f"_x_{n}").over(to_here) for n in sums})

    def carry(chunks: DataFrame) -> DataFrame:
        w = _before(keys)
        return chunks.select(*keys, _CHUNK, *[F.coalesce(F.sum(f"_t_{n}").over(w), F.lit(0)).alias(f"_c_{n}") for n in sums])

    out = with_carry(lay, local, {f"_t_{n}": F.sum(f"_x_{n}") for n in sums}, carry)
    out = out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) + F.col(f"_c_{n}") for n in sums})
    return out.drop(_CHUNK, _POS, *[f"_{p}_{n}" for n in sums for p in ("x", "c")])


def expanding_stats(df: DataFrame, keys: list[str], order: list[str], x: str, max_rows: int | None = None) -> DataFrame:
    """`mu` and `sigma` over all earlier rows of the key, the current row excluded."""
    lay = lay_out(df, keys, order, max_rows)
    w = lay.window().rowsBetween(Window.unboundedPreceding, -1)
    local = lay.df.withColumns(
        {"_n": F.count(x).over(w), "_m": F.avg(x).over(w), "_q": F.coalesce(F.var_pop(x).over(w) * F.count(x).over(w), F.lit(0.0))}
    )

    def carry(chunks: DataFrame) -> DataFrame:
        b = _before(keys)
        # means are taken as distances from the key's first one: their squares cancel without loss
        base = F.first(F.when(F.col("_tn") > 0, F.col("_tm")), ignorenulls=True).over(b)
        chunks = chunks.withColumn("_base", F.coalesce(base, F.col("_tm"))).withColumn("_off", F.col("_tm") - F.col("_base"))
        n, s = F.sum("_tn").over(b), F.sum(F.col("_tn") * F.col("_off")).over(b)
        square = F.sum(F.col("_tq") + F.col("_tn") * F.col("_off") * F.col("_off")).over(b)
        return chunks.select(
            *keys, _CHUNK,
            F.coalesce(n, F.lit(0)).alias("_cn"),
            (F.col("_base") + s / F.nullif(n, F.lit(0))).alias("_cm"),
            F.coalesce(square - s * s / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("_cq"),
        )

    totals = {"_tn": F.count(x), "_tm": F.coalesce(F.avg(x), F.lit(0.0)), "_tq": F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0))}
    out = with_carry(lay, local, totals, carry)
    n1, n2 = F.col("_cn"), F.col("_n")
    m1, m2 = F.coalesce(F.col("_cm"), F.lit(0.0)), F.coalesce(F.col("_m"), F.lit(0.0))
    n = n1 + n2
    both = F.nullif(n, F.lit(0))
    q = F.col("_cq") + F.col("_q") + (m2 - m1) * (m2 - m1) * n1 * n2 / both
    out = out.withColumns(
        {"mu": (n1 * m1 + n2 * m2) / both, "sigma": F.sqrt(F.greatest(q, F.lit(0.0)) / F.nullif(n - 1, F.lit(0)))}
    )
    out = out.withColumn("sigma", F.when(n > 1, F.col("sigma")))
    return out.drop(_CHUNK, _POS, "_n", "_m", "_q", "_cn", "_cm", "_cq")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], cols: list[str], max_rows: int | None = None) -> DataFrame:
    """Replace NULLs in `cols` by the key's last known value."""
    lay = lay_out(df, keys, order, max_rows)
    w = lay.window().rowsBetween(Window.unboundedPreceding, 0)
    local = lay.df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})

    def carry(chunks: DataFrame) -> DataFrame:
        b = _before(keys)
        return chunks.select(*keys, _CHUNK, *[F.last(f"_t_{c}", ignorenulls=True).over(b).alias(f"_c_{c}") for c in cols])

    # the last row of a chunk already holds the last known value of the chunk
    out = with_carry(lay, local, {f"_t_{c}": F.max_by(c, _POS) for c in cols}, carry)
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_c_{c}")) for c in cols})
    return out.drop(_CHUNK, _POS, *[f"_c_{c}" for c in cols])
