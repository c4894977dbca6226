"""Tables written between steps, and small helpers that several operators share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

SPACES = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared scratch folder: cuts the lineage and outlives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """The two columns that most operators read; whatever else the table holds stays out of the way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the decimal id leaves the remainder `fold`; an id that is null is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string column, without a copy where nothing is null."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def doc_ranges(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows [lo, hi) of at most `limit` bytes together; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node it is tied to) with the components of the edges (u, v): at most one edge a node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def keyed(df: DataFrame, *tie: str) -> DataFrame:
    """`df` with a key for each row, repeated rows too: __h (hash of the text) and __turn among rows of one id and text.

    Decisions made on a narrow table find their rows again by (doc_id, __h, __turn).
    """
    w = Window.partitionBy("doc_id", "__h").orderBy(*[F.col(f"`{c}`") for c in tie] or [F.lit(0)])
    df = df if "__h" in df.columns else df.withColumn("__h", F.xxhash64(F.col("text").cast("string")))
    return df.withColumn("__turn", F.row_number().over(w))


def shielded(docs: DataFrame, *known: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with all columns but `known` under names that no operator uses inside, and the way back to its own names."""
    inner = [c if c in known else f"c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*inner), lambda df: df.select(*[F.col(n).alias(c) for n, c in zip(inner, docs.columns)])


def rejoined(docs: DataFrame, decided: DataFrame, *tie: str) -> DataFrame:
    """Rows of `docs` beside the decisions of `decided`, which has doc_id, __h and __turn; both by the same tie columns."""
    d = decided.withColumnsRenamed({"doc_id": "__id", "__h": "__dh", "__turn": "__dt"})
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__dh")) & (F.col("__turn") == F.col("__dt"))
    return keyed(docs, *tie).join(d, on).drop("__id", "__dh", "__dt", "__h", "__turn")
