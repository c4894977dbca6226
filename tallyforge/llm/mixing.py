"""Mixing sources to target weights by systematic sampling: whole documents, each a fixed number of times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, keyed, rejoined, shielded, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
_SLICES = 64


def _md5_number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """Narrow rows: doc_id, source, __h, __turn and size, the number of white-space words (null: 0)."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(SPACES)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("__h"), size.alias("size"))
    return keyed(rows, "source")


def targets(rows: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target), one row per source.

    Sources by code point, null last, have the weights in turn and share `share` of all sizes; none gets more than
    `most` times its own, and what is over goes to the others by weight. So a target is the smaller of its bound and
    weight x level: with sources in order of bound / weight, the level is the first at which the next one stays below.
    The windows here hold one row per source.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("most") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bound = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    per = per.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - bound) / rest)
    level = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(whole)
    per = per.withColumn("final", level)
    return per.select("source", "source_size", F.coalesce(F.least("most", F.col("final") * F.col("w")), F.col("most")).alias("target"))


def mix_plan(rows: DataFrame, per: DataFrame, seed: int = 0) -> DataFrame:
    """`rows` of `sized` with source_size, target and copies.

    Every document of a source is expected target / source_size times. In order of size, largest first, a document gets
    one copy for each integer that the running sum of expectations, shifted by the source's random offset, passes in it:
    so the words taken miss the target by about the size of the largest document at most. The running sum is the rank
    times the expectation; ranks come from counts of small cells (source, size class, slice of the id) and a number
    within the cell, so that no window holds a whole source. The offset depends on seed and source alone.
    """
    length = F.length(F.bin("size"))
    rows = rows.withColumn("cell", length * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))"))
    rows = rows.withColumn("slice", F.coalesce(_md5_number(F.col("doc_id").cast("string"), 4) % _SLICES, F.lit(0)))
    cells = rows.groupBy("source", "cell", "slice").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy(F.desc("cell"), "slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    cells = cells.join(per, cells["source"].eqNullSafe(per["source"])).drop(per["source"]).withColumnsRenamed({"source": "s", "cell": "c", "slice": "l"})
    in_cell = Window.partitionBy("source", "cell", "slice").orderBy(F.desc("size"), "doc_id", "__h", "__turn")
    placed = rows.withColumn("place", F.row_number().over(in_cell))
    placed = placed.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")) & (F.col("slice") == F.col("l")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = _md5_number(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit(""))), 8) / F.lit(float(1 << 32))
    rank = F.col("before") + F.col("place")
    copies = (F.floor(rank * expected + offset) - F.floor((rank - 1) * expected + offset)).cast("int")
    return placed.select("doc_id", "source", "__h", "__turn", "size", "source_size", "target", copies.alias("copies"))


def mixture(docs: DataFrame, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, and the keys of `keyed`.

    Null and empty texts have size 0 and are taken as often as their source's other documents; a source of size 0 has
    target 0 and is not taken; null is a source like any other; repeated rows are documents of their own; an empty
    table gives no row.
    """
    rows = written(sized(docs), "sized")
    return mix_plan(rows, written(targets(rows), "targets"), seed)


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """`docs` mixed: each row as many times as the plan says, with the columns it had, whatever their names."""
    inner, back = shielded(docs, "doc_id", "source", "text")
    plan = mixture(inner, seed).where("copies > 0").select("doc_id", "__h", "__turn", F.col("copies").alias("__copies"))
    return back(rejoined(inner, plan, "source").withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))))
