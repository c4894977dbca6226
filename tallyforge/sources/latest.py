"""A stored table of the newest row of every key, so that views of the present never read the history.

The table is partitioned by a hash of the key. A batch is cut down to its own newest rows first and then meets only the
partitions it touches, which are staged and replaced; rows that come late lose against what is stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import latest_per_key
from ..session import written
from .maintenance import _exists

SLOTS = 64
_SLOT = "slot"


def merge_latest(batch: DataFrame, path: str, keys: list[str], ts: str, tie: str, slots: int = SLOTS) -> list[int]:
    """Merge the rows of `batch` into the table at `path`; returns the partitions rewritten, `slots` at most.

    Of one key the newest time wins, of one time the largest `tie`; keys may be NULL. Merging a batch again changes
    nothing, so a retry is harmless. `slots` must stay the same for one table.
    """
    slot = F.pmod(F.xxhash64(F.struct(*keys)), F.lit(slots)).cast("int").alias(_SLOT)
    new = written(latest_per_key(batch, keys, ts, tie).select("*", slot), "newest")
    touched = sorted(r[0] for r in new.select(_SLOT).distinct().collect())
    if not touched:
        return []
    rows = new
    if _exists(batch.sparkSession, path):
        held = read_latest(batch.sparkSession, path, batch).where(F.col(_SLOT).isin(touched))
        rows = latest_per_key(held.unionByName(new), keys, ts, tie)
    # staged first: a table cannot be read and overwritten in one job
    staged = written(rows, "merged")
    # one file a partition: the rows of a partition are one task's
    staged.repartition(_SLOT).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_SLOT).parquet(path)
    return touched


def read_latest(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table, with the columns of `like` and the partition number."""
    return spark.read.schema(T.StructType([*like.schema.fields, T.StructField(_SLOT, T.IntegerType())])).parquet(path)


def latest_writer(path: str, keys: list[str], ts: str, tie: str, slots: int = SLOTS) -> Callable[[DataFrame, int], None]:
    """foreachBatch: keep the table up to date from a stream."""

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_latest(batch, path, keys, ts, tie, slots)

    return write
