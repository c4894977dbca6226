"""Connected components of an edge table, by alternating large and small stars.

Each round is a few aggregations and joins on a vertex; its edges are written to the shared scratch folder, so nothing
is collected and a lost executor costs one round. The smallest vertex of a component becomes its root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("v", "u").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def _tied_to_least(near: DataFrame) -> DataFrame:
    """(u, v) rows beside the least neighbour of u, u itself included."""
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every vertex of `edges` (columns a, b; longs) that is not its component's smallest vertex.

    Edges with a null end and loops tie nothing; repeated edges count once; an empty table gives an empty table.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    e = written(e, "edges")
    before = _signature(e)
    while before[0]:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _tied_to_least(both).where("v > u").select("v", F.col("m").alias("u")).distinct()
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        tied = _tied_to_least(down)
        small = tied.where("v <> m").select("v", F.col("m").alias("u")).unionByName(tied.select(F.col("u").alias("v"), F.col("m").alias("u")))
        e = written(small.distinct(), "edges")
        now = _signature(e)
        if now == before:
            break
        before = now
    return e.select(F.col("v").alias("node"), F.col("u").alias("root"))
