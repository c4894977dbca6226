"""Written tables: partitioned layout, compaction, retention, snapshots, incremental rollups, staging ledger."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import interval_us, minus, time_bucket, ts_lit, ts_plus
from ..operators.rollup import tier_for
from ..session import scratch_path

# Partition grain of the raw tables, rollup refresh windows, and retention periods.
PARTITION_GRAIN = {"telemetry": "1 hour", "sys": "1 day", "net": "1 day", "alarms": "7 days"}
REFRESH = {
    "telemetry_1m": ("2 hours", "1 minute"), "telemetry_15m": ("3 hours", "15 minutes"), "telemetry_1h": ("1 day", "1 hour"),
    "telemetry_hourly": ("3 days", "1 hour"), "infra_hourly": ("3 hours", "1 hour"), "infra_daily": ("3 days", "2 hours"),
    "infra_weekly": ("15 days", "6 hours"),
}
RETENTION = {
    "sys": "14 days", "net": "14 days", "ldi": "14 days", "infra_hourly": "90 days", "infra_daily": "730 days",
    "telemetry": "180 days", "alarms": "365 days", "telemetry_1m": "30 days", "telemetry_15m": "90 days", "telemetry_1h": "730 days",
}


def partition_columns(ts: str, grain: str) -> dict[str, Column]:
    """Directory columns of a time-partitioned table: date, plus hour below one day, or the first day of the week."""
    if grain == "1 hour":
        return {"date": F.to_date(ts), "hour": F.hour(ts)}
    if grain == "7 days":
        return {"week": F.to_date(time_bucket(ts, "1 week"))}
    return {"date": F.to_date(ts)}


def write_partitioned(df: DataFrame, path: str, ts: str, grain: str = "1 day", mode: str = "append") -> None:
    """Write with directories by time; rows of one directory meet in few tasks, so files stay few and large.

    The rebalance hint lets the engine split a directory that is much larger than the others.
    """
    parts = partition_columns(ts, grain)
    out = df.withColumns(parts).hint("rebalance", *[F.col(c) for c in parts])
    out.write.mode(mode).partitionBy(*parts).parquet(path)


def compact(df: DataFrame, segment_by: list[str], order_by: list[Column], files: int | None = None) -> DataFrame:
    """Cold layout: equal segments side by side, ordered inside, so Parquet statistics skip row groups.

    Range partitioning on segment and order splits a segment that is too large for one file.
    """
    keys = [*[F.col(c) for c in segment_by], *order_by]
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def apply_retention(df: DataFrame, ts: str, keep: str, as_of: datetime | str) -> DataFrame:
    """Rows not older than the retention period."""
    return df.where(F.col(ts) >= ts_lit(minus(as_of, keep)))


def drop_expired(spark: SparkSession, path: str, keep: str, as_of: datetime | str) -> DataFrame:
    """Remove the directories of a date-partitioned table that are wholly older than the retention period.

    Returns the dates removed; one driver row per directory, as many as there are days.
    """
    cut = minus(as_of, keep).date()
    fs, root = _files(spark, path)
    dates = [p.getPath() for p in fs.listStatus(root) if p.getPath().getName().startswith("date=")]
    old = [p for p in dates if p.getName().removeprefix("date=") < cut.isoformat()]
    for p in old:
        fs.delete(p, True)
    return spark.createDataFrame([(p.getName().removeprefix("date="),) for p in old], "date string").select(F.col("date").cast("date").alias("date"))


def enforce_fk(fact: DataFrame, devices: DataFrame, key: str = "device_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) facts by whether their device is registered."""
    ids = devices.select(F.col("device_id").alias(key))
    return fact.join(ids, key, "left_semi"), fact.join(ids, key, "left_anti")


def bulk_replace(df: DataFrame, path: str, table: str) -> DataFrame:
    """Replace a table and report its row count, read back from what was written."""
    df.write.mode("overwrite").parquet(path)
    written = df.sparkSession.read.parquet(path)
    return written.agg(F.lit(table).alias("table_name"), F.count(F.lit(1)).alias("row_count"))


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers of the complete directories `name=<n>` below `root`, ascending: one is complete once its job committed."""
    fs, p = _files(spark, root)
    if not fs.exists(p):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    found = [x.getPath() for x in fs.listStatus(p) if x.getPath().getName().startswith(f"{name}=")]
    return sorted(int(x.getName().removeprefix(f"{name}=")) for x in found if fs.exists(done(x, "_SUCCESS")))


def _versions(spark: SparkSession, root: str) -> list[int]:
    return _numbers(spark, root, "version")


def batch_numbers(spark: SparkSession, root: str) -> list[int]:
    """Ids of the batches written below `root`."""
    return _numbers(spark, root, "batch")


def refresh_snapshot(spark: SparkSession, root: str, builder: Callable[[], DataFrame]) -> DataFrame:
    """Write a new version beside the old ones; its commit makes it the current one, in one step.

    Nothing is overwritten, so readers of an older version are not disturbed and never find none.
    """
    done = _versions(spark, root)
    builder().write.mode("overwrite").parquet(f"{root}/version={done[-1] + 1 if done else 0}")
    return read_snapshot(spark, root)


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete version."""
    return spark.read.parquet(f"{root}/version={_versions(spark, root)[-1]}")


def expire_snapshots(spark: SparkSession, root: str, grace: str = "1 hour", now: datetime | None = None) -> list[int]:
    """Remove versions that were replaced longer than `grace` ago, so that a reader has that long to finish; returns them.

    A version counts as replaced when the next one committed. The current version always stays.
    """
    fs, p = _files(spark, root)
    done = _versions(spark, root)
    path = lambda v: spark._jvm.org.apache.hadoop.fs.Path(p, f"version={v}")
    committed = {v: fs.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path(v), "_SUCCESS")).getModificationTime() for v in done}
    limit = int((now.timestamp() if now else time.time()) * 1000) - interval_us(grace) // 1000
    old = [v for v, after in zip(done, done[1:]) if committed[after] < limit]
    for v in old:
        fs.delete(path(v), True)
    return old


def refresh_window(as_of: datetime | str, start_offset: str, end_offset: str) -> tuple[datetime, datetime]:
    return minus(as_of, start_offset), minus(as_of, end_offset)


def refresh_rollup(
    raw: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], ts: str, width: str, as_of: datetime | str,
    start_offset: str, end_offset: str,
) -> DataFrame:
    """Recompute the whole buckets inside [as_of - start, as_of - end) and overwrite only their directories.

    Buckets are stored by `date`; a touched day keeps its buckets outside the window. Returns the table.
    """
    spark = raw.sparkSession
    lo, hi = refresh_window(as_of, start_offset, end_offset)
    first = time_bucket(ts_lit(lo), width)
    first = F.when(first < ts_lit(lo), F.timestamp_micros(F.unix_micros(first) + F.lit(interval_us(width)))).otherwise(first)
    end = time_bucket(ts_lit(hi), width)
    fresh = build(raw.where((F.col(ts) >= first) & (F.col(ts) < end))).withColumn("date", F.to_date("bucket"))
    staged = scratch_path(spark, "rollup")
    if _exists(spark, path):
        stored = spark.read.parquet(path)
        days = stored.where(F.col("date").between(F.to_date(first), F.to_date(end)))
        keep = days.where((F.col("bucket") < first) | (F.col("bucket") >= end))
        fresh = fresh.unionByName(keep.withColumn("date", F.to_date("bucket")))
    # staged first: a table cannot be read and overwritten in one job
    fresh.write.parquet(staged)
    out = spark.read.parquet(staged).withColumn("date", F.to_date("bucket"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def realtime_rollup(mat: DataFrame, raw: DataFrame, build: Callable[[DataFrame], DataFrame], ts: str, watermark: datetime | str) -> DataFrame:
    """Stored buckets below the watermark together with buckets built from newer raw rows; no bucket comes twice.

    The watermark must be a bucket boundary.
    """
    old = mat.where(F.col("bucket") < ts_lit(watermark))
    live = build(raw.where(F.col(ts) >= ts_lit(watermark)))
    return old.unionByName(live.select(*old.columns))


def read_stored_tier(
    spark: SparkSession, root: str, raw: DataFrame, builds: dict[str, Callable[[DataFrame], DataFrame]], ts: str, lo: datetime | str, hi: datetime | str, watermark: datetime | str,
) -> DataFrame:
    """Buckets in [lo, hi] of the stored tier that fits the range, and live ones built from raw rows past the watermark.

    Tiers lie below `root` by name and date, so the range prunes directories; the raw scan is bounded by time.
    """
    tier = tier_for(lo, hi)
    stored = spark.read.parquet(f"{root}/{tier}").where(F.col("date").between(F.to_date(ts_lit(lo)), F.to_date(ts_lit(hi)))).drop("date")
    # no bucket is longer than an hour
    past = raw.where(F.col(ts) < ts_plus(ts_lit(hi), interval_us("1 hour")))
    both = realtime_rollup(stored, past, builds[tier], ts, watermark)
    return both.where(F.col("bucket").between(ts_lit(lo), ts_lit(hi)))


LEDGER = (
    "batch_id BIGINT, target_table STRING, source_ts TIMESTAMP, staged_at TIMESTAMP, status STRING, attempts INT, "
    "last_error STRING, committed_at TIMESTAMP, row_count BIGINT, payload_path STRING"
)


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink with one directory per batch: a batch that is written again replaces itself."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def stage_batch(batch: DataFrame, batch_id: int, target_table: str, ledger_path: str, payload_root: str, source_ts: str, write: Callable[[DataFrame, int], None]) -> str:
    """Store the batch and a 'pending' ledger row, write it, then add 'committed' or 'failed'. Returns the status.

    The ledger only grows: the newest row of a batch is its state (see `ledger_state`). A crash between the write and
    'committed' leaves the batch open, and it is written once more; so `write` must be idempotent per batch id, as
    `batch_sink` is. Use inside foreachBatch.
    """
    spark = batch.sparkSession
    payload = f"{payload_root}/{target_table}/batch={batch_id}"
    batch.write.mode("overwrite").parquet(payload)
    stored = spark.read.parquet(payload)
    facts = stored.agg(F.count(F.lit(1)).alias("row_count"), F.max(source_ts).alias("source_ts"))

    def log(status: str, error: str | None) -> None:
        facts.select(
            F.lit(batch_id).cast("long").alias("batch_id"), F.lit(target_table).alias("target_table"), "source_ts",
            F.current_timestamp().alias("staged_at"), F.lit(status).alias("status"), F.lit(0 if status == "pending" else 1).alias("attempts"),
            F.lit(error).cast("string").alias("last_error"),
            (F.current_timestamp() if status == "committed" else F.lit(None).cast("timestamp")).alias("committed_at"),
            "row_count", F.lit(payload).alias("payload_path"),
        ).write.mode("append").parquet(ledger_path)

    log("pending", None)
    try:
        write(stored, batch_id)
    except Exception as e:  # the batch stays replayable from its stored payload
        log("failed", str(e)[:500])
        return "failed"
    log("committed", None)
    return "committed"


def ledger_state(ledger: DataFrame) -> DataFrame:
    """Current state of every batch: committed wins, else the newest entry; attempts add up."""
    rank = F.struct((F.col("status") == "committed").cast("int"), F.col("staged_at"), F.col("attempts"))
    rest = [c for c in ledger.columns if c not in ("batch_id", "target_table", "attempts")]
    return ledger.groupBy("batch_id", "target_table").agg(F.sum("attempts").cast("int").alias("attempts"), F.max_by(F.struct(*rest), rank).alias("r")).select(
        "batch_id", "target_table", "attempts", "r.*"
    )


def replay(spark: SparkSession, ledger_path: str, ledger_payload_root: str, source_ts: str, write: Callable[[DataFrame, int], None]) -> int:
    """Write again every batch that was open at the start; returns how many were tried. One ledger row at a time."""
    state = ledger_state(spark.read.schema(LEDGER).parquet(ledger_path)).where(F.col("status") != "committed")
    path = scratch_path(spark, "open-batches")
    state.select("batch_id", "target_table", "payload_path").write.parquet(path)
    todo = spark.read.parquet(path).orderBy("batch_id", "target_table")
    tried = 0
    for b in todo.toLocalIterator():
        payload = spark.read.parquet(b.payload_path)
        stage_batch(payload, b.batch_id, b.target_table, ledger_path, scratch_path(spark, "replay"), source_ts, write)
        tried += 1
    return tried
