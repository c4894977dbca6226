"""Data quality: latency, completeness, catalog checks, reconciliation, lateness."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import last, rnd, seconds_between, time_bucket, ts_lit
from ..functions.timeutil import interval_us
from .aggregates import exact_percentiles
from .series import over_rows
from .snapshot import time_grid

LATENCY_PROBS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def ingest_latency(df: DataFrame, src: str, ingest: str = "ingest_ts", keys: list[str] | None = None, grain: str | None = None, as_of: datetime | str | None = None, window: str | None = None) -> DataFrame:
    """Source-to-commit milliseconds: exact P50, P95, P99 per key and, with `grain`, per bucket."""
    rows = last(df, src, window, as_of) if window else df
    rows = rows.where(F.col(ingest).isNotNull()).withColumn("_ms", seconds_between(F.col(ingest), F.col(src)) * 1000)
    by = list(keys or [])
    if grain:
        rows = rows.withColumn("bucket", time_bucket(src, grain))
        by.append("bucket")
    out = exact_percentiles(rows, by, "_ms", LATENCY_PROBS)
    return out.withColumns({p: rnd(p, 3) for p in LATENCY_PROBS})


def expected_rows(df: DataFrame, key: str, ts: str, interval: str, lo: datetime | str, hi: datetime | str) -> DataFrame:
    """Rows per key against the number a fixed poll interval should have given."""
    us = interval_us(interval)
    span = F.unix_micros(ts_lit(hi)) - F.unix_micros(ts_lit(lo))
    return df.where(F.col(ts).between(ts_lit(lo), ts_lit(hi))).groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(
        key, "n", rnd(span / F.lit(us), 4).alias("expected"), rnd(F.col("n") * 100.0 / (span / F.lit(us)), 2).alias("pct")
    )


def gap_report(df: DataFrame, key: str, ts: str, tie: str, max_rows: int | None = None) -> DataFrame:
    """Smallest, mean and largest gap between a key's consecutive rows, in seconds."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumn("_gap", (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))) / F.lit(1e6))

    gaps = over_rows(df.select(key, ts, tie), [key], [ts, tie], 1, build, max_rows)
    return gaps.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.min("_gap"), 3).alias("min_gap"), rnd(F.avg("_gap"), 3).alias("avg_gap"), rnd(F.max("_gap"), 3).alias("max_gap")
    )


def empty_buckets(df: DataFrame, keys: DataFrame, key: str, ts: str, lo: datetime | str, hi: datetime | str, step: str = "15 minutes") -> DataFrame:
    """Buckets of [lo, hi) in which a key has no row."""
    seen = df.where((F.col(ts) >= ts_lit(lo)) & (F.col(ts) < ts_lit(hi))).select(key, time_bucket(ts, step).alias("bucket")).distinct()
    return time_grid(keys.select(key), lo, hi, step).join(seen, [key, "bucket"], "left_anti")


def recent_activity(df: DataFrame, key: str, ts: str, as_of: datetime | str, window: str = "5 minutes") -> DataFrame:
    return last(df, ts, window, as_of).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("latest"))


# Words that give away placeholder text.
PLACEHOLDER = "test|todo|tbd|lorem|xxx|foo|bar|debug|dummy|sample|placeholder"


def placeholder_text(catalog: DataFrame) -> DataFrame:
    """Catalog rows with placeholder, empty or very short text."""
    msg, detail = F.col("alarm_msg"), F.col("alarm_detail")
    bad = msg.rlike(f"(?i){PLACEHOLDER}") | (msg == "") | msg.isNull() | (detail == "") | (F.length(detail) < 5)
    return catalog.where(bad).select("alarm_id", "alarm_msg", "alarm_detail")


def duplicate_messages(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("alarm_msg").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def orphan_codes(alarms: DataFrame, catalog: DataFrame) -> DataFrame:
    """Codes that fire but are not in the catalog; codes are deduplicated before the anti join."""
    fired = alarms.groupBy("errorcode").agg(F.count(F.lit(1)).alias("n"))
    return fired.join(catalog.select(F.col("alarm_code").alias("errorcode")), "errorcode", "left_anti")


def category_coverage(alarms: DataFrame, category: DataFrame, floor_pct: float = 45.0) -> DataFrame:
    """Share of the fired codes that have a category, against a floor."""
    fired = alarms.select("errorcode").distinct()
    known = category.where(F.col("category") != "UNCLASSIFIED").select(F.col("alarm_code").alias("errorcode")).distinct().withColumn("_k", F.lit(1))
    share = F.count("_k") * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))
    return fired.join(known, "errorcode", "left").agg(
        F.count(F.lit(1)).alias("codes"), F.count("_k").alias("categorised"), rnd(share, 1).alias("coverage_pct"), (rnd(share, 1) >= floor_pct).alias("ok")
    )


def reconcile(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Row counts of two copies, keys on one side only, and keys whose rows differ.

    Each side is reduced to one hash per key first; the comparison is one full outer join of those.
    """
    cols = [c for c in a.columns if c in b.columns]

    def digest(df: DataFrame, name: str) -> DataFrame:
        h = F.xxhash64(*cols).cast("decimal(38,0)")
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.sum(h).alias(f"h_{name}"))

    both = digest(a, "a").join(digest(b, "b"), keys, "outer")
    na, nb = F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))
    differs = F.col("n_a").isNotNull() & F.col("n_b").isNotNull() & ((na != nb) | (F.col("h_a") != F.col("h_b")))
    return both.agg(
        F.coalesce(F.sum(na), F.lit(0)).alias("rows_a"), F.coalesce(F.sum(nb), F.lit(0)).alias("rows_b"),
        F.count_if(F.col("n_b").isNull()).alias("only_a"), F.count_if(F.col("n_a").isNull()).alias("only_b"), F.count_if(differs).alias("changed"),
    )


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns, types and nullability present on one side only."""
    spark = a.sparkSession

    def listing(df: DataFrame) -> DataFrame:
        return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields], "column_name string, type string, nullable boolean")

    la, lb = listing(a), listing(b)
    only_a = la.exceptAll(lb).withColumn("side", F.lit("a"))
    return only_a.unionByName(lb.exceptAll(la).withColumn("side", F.lit("b")))


def pipeline_throughput(ledger: DataFrame, grain: str = "1 minute") -> DataFrame:
    """Rows per second and batch success rate per table and bucket, from the staging ledger."""
    seconds = interval_us(grain) / 1e6
    done = F.col("status") == "committed"
    return ledger.groupBy("target_table", time_bucket("staged_at", grain).alias("bucket")).agg(
        rnd(F.coalesce(F.sum(F.when(done, F.col("row_count"))), F.lit(0)) / F.lit(seconds), 4).alias("rows_per_sec"),
        rnd(F.count_if(done) * 100.0 / F.count(F.lit(1)), 2).alias("success_pct"),
    )


def lateness_report(df: DataFrame, ts: str, ingest: str, now: datetime | str, keys: list[str] | None = None) -> DataFrame:
    """Rows stamped before they happened, rows from the future, and rows without a stamp."""
    early: Column = F.col(ingest) < F.col(ts)
    aggs = [
        F.count(F.lit(1)).alias("n"), F.count_if(early).alias("ingest_before_source"),
        F.count_if(F.col(ts) > ts_lit(now)).alias("future"), F.count_if(F.col(ingest).isNull()).alias("unstamped"),
    ]
    return df.groupBy(*(keys or [])).agg(*aggs)
