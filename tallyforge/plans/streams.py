"""Streaming jobs run over the benchmark tables until everything available is processed."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..session import scratch_path
from ..sources import ingest, varbinds
from ..streaming import jobs, ordered
from .operations import RESETTING_SQL, SUSTAINED_SQL, _debounce_sql, actions, alert_changes, evaluations, readings
from .registry import ORACLES, query, r
from .storage import _INGESTED, _ingested, all_walks, shown_walks, telemetry_json
from .tables import AS_OF, Tables

# allowance that covers the order in which one file is read
_ALL = "60 days"


def stream_of(t: Tables, name: str, view: str) -> DataFrame:
    """A view as a stream over its table's file."""
    rows = t.spark.readStream.schema(t.schema(name)).option("maxFilesPerTrigger", 1).parquet(t.glob(name))
    return t.shape(rows, view)


def by_time(df: DataFrame, ts: str, slices: int = 3) -> list[DataFrame]:
    """Consecutive stretches of time, as an append-only source delivers them."""
    lo, hi = df.agg(F.unix_micros(F.min(ts)), F.unix_micros(F.max(ts))).first()
    cut = [lo + (hi + 1 - lo) * i // slices for i in range(slices + 1)]
    us = F.unix_micros(ts)
    return [df.where((us >= a) & (us < b)) for a, b in zip(cut, cut[1:])]


def deliver(t: Tables, parts: list[DataFrame], label: str, run: Callable[[DataFrame, str], object]) -> None:
    """Append one delivery after the other to a table and let the stream catch up; state lives in its checkpoint."""
    path, checkpoint = scratch_path(t.spark, f"{label}-in"), scratch_path(t.spark, f"{label}-ckpt")
    for part in parts:
        part.write.mode("append").parquet(path)
        run(t.spark.readStream.schema(part.schema).parquet(path), checkpoint)


def streamed(t: Tables, parts: list[DataFrame], label: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Output table of `build(stream)` after all deliveries."""
    out, results = scratch_path(t.spark, label), []
    deliver(t, parts, label, lambda source, ckpt: results.append(jobs.run_available(build(source), label, out=out, checkpoint=ckpt)))
    return results[-1]


_SPEC = {"avg_temperature": ("avg", "temperature"), "max_time": ("max", "total_time")}
_ROLL = f"SELECT time_bucket(INTERVAL '{{w}}', time) AS bucket, process, count(*) AS sample_count, {r('avg(temperature)', 4)} AS avg_temperature, {r('max(total_time)', 4)} AS max_time FROM tele GROUP BY 1, 2"


def _out(df: DataFrame) -> DataFrame:
    return df.select("bucket", "process", "sample_count", fn.rnd("avg_temperature", 4).alias("avg_temperature"), fn.rnd("max_time", 4).alias("max_time"))


@query("sm1_stream_rollup", "tele", _ROLL.format(w="1 hour"))
def _(t: Tables) -> DataFrame:
    agg = jobs.stream_rollup(stream_of(t, "events", "tele"), "time", "1 hour", _ALL, ["process"], _SPEC)
    # complete buckets only leave when the watermark passes; at the end of a bounded input the rest is read in update mode
    return _out(_complete(t, agg, "sm1"))


def _complete(t: Tables, agg: DataFrame, label: str, mode: str = "update") -> DataFrame:
    """Final state of a windowed aggregation over a bounded stream: its updates, newest per group.

    Session windows have no updates; for them every batch holds the complete result so far.
    """
    out = scratch_path(t.spark, label)
    keys = [c for c in agg.columns if c in ("bucket", "process", "device_id", "cycle_start", "key")]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    agg.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}-ckpt").trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.parquet(f"{out}/batch=*")
    rest = [c for c in agg.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")


@query("sm2_stream_cascade", "tele", _ROLL.format(w="1 hour"))
def _(t):
    root = scratch_path(t.spark, "cascade")
    writer = jobs.cascade_writer(root, "time", ["process"], _SPEC, ["1 minute", "15 minutes", "1 hour"])
    rows = t.tele.select("time", "process", "temperature", "total_time", "log_id")
    deliver(t, by_time(rows, "time", 2), "cascade", lambda source, ckpt: jobs.run_batches(source, writer, ckpt))
    return _out(t.spark.read.parquet(f"{root}/1_hour"))


@query("sm2_stream_cascade_week", "tele", _ROLL.format(w="7 days"))
def _(t):
    root = scratch_path(t.spark, "cascade")
    writer = jobs.cascade_writer(root, "time", ["process"], _SPEC, ["1 hour", "1 day", "1 week"])
    rows = t.tele.select("time", "process", "temperature", "total_time", "log_id")
    # the cut falls inside a week: its earlier days must stay in the recomputed total
    deliver(t, by_time(rows, "time", 2), "cascade", lambda source, ckpt: jobs.run_batches(source, writer, ckpt))
    return _out(t.spark.read.parquet(f"{root}/1_week"))


@query("sm3_counter_rate_stream")
def _(t):
    return streamed(t, by_time(t.counters, "ts"), "rates", jobs.counter_rate_stream)


ORACLES["sm3_counter_rate_stream"] = ORACLES["wn8_counter_rate"]


@query("sm4_carry_forward_stream", "tele", "SELECT log_id, round(last(air_vacuum IGNORE NULLS) OVER w, 4) AS air_vacuum FROM tele WINDOW w AS (PARTITION BY eqp_id ORDER BY time, log_id ROWS UNBOUNDED PRECEDING)")
def _(t):
    rows = t.tele.select("time", "eqp_id", "log_id", "air_vacuum")
    out = streamed(t, by_time(rows, "time"), "carry", lambda s: jobs.carry_forward_stream(s, "eqp_id", "time", "log_id", ["air_vacuum"]))
    return out.select("log_id", F.round("air_vacuum", 4).alias("air_vacuum"))


@query("sm5_assemble_cycle_stream")
def _(t):
    agg = jobs.assemble_cycle(stream_of(t, "events", "cycles").drop("event_id"), "1 hour", watermark=_ALL)
    return _complete(t, agg, "cycles", "complete").withColumn("walkers", F.array_join("walkers", ","))


ORACLES["sm5_assemble_cycle_stream"] = ORACLES["sm5_assemble_cycle"]


def closed(df: DataFrame, ts: str, days: int = 60, **key: str) -> DataFrame:
    """One row of a key of its own long after all others: the watermark passes everything that came before."""
    end = df.agg(fn.ts_plus(F.max(ts), fn.interval_us(f"{days} days")).alias(ts))
    return end.select(*[(F.col(ts) if f.name == ts else F.lit(key.get(f.name)).cast(f.dataType)).alias(f.name) for f in df.schema.fields])


@query("sm5_poll_cycle_stream")
def _(t):
    parts = [*by_time(t.cycles, "ts"), closed(t.cycles, "ts", device_id="~", walker="cpu")]
    out = streamed(t, parts, "polls", lambda s: ordered.poll_cycles_stream(s, "36 hours", tie="event_id"))
    return out.withColumn("walkers", F.array_join("walkers", ","))


ORACLES["sm5_poll_cycle_stream"] = ORACLES["sm5_poll_cycle"]


@query("src2_device_state_stream")
def _(t):
    rows = varbinds.whole_walks(all_walks(t))
    parts = [*by_time(rows, "ts"), closed(rows, "ts", device_id="~", walker="cpu")]
    return shown_walks(streamed(t, parts, "states", lambda s: ordered.device_state_stream(s, keep="90 days")))


ORACLES["src2_device_state_stream"] = ORACLES["src2_device_state"]


@query("sm6_debounce_stream", "", _debounce_sql(96, "SELECT logid FROM f WHERE fired"))
def _(t):
    rows = t.alarms.select("equipmentid", "errorcode", "logdate", "logid")
    return streamed(t, by_time(rows, "logdate"), "fired", lambda s: jobs.debounce_stream(s, "96 hours")).select("logid")


@query("sm7_lifecycle_stream")
def _(t):
    return streamed(t, by_time(actions(t), "action_ts"), "lifecycle", jobs.lifecycle_stream).where(F.col("reason").isNotNull()).select("logid", "logdate", "action_id", "action", "reason")


ORACLES["sm7_lifecycle_stream"] = f"SELECT logid, logdate, action_id, action, reason FROM ({ORACLES['sm7_lifecycle_rejected']})"


@query("sm7_lifecycle_births_stream")
def _(t):
    births, asked, out, ckpt = (scratch_path(t.spark, x) for x in ("births", "asked", "births-out", "births-ckpt"))
    own, acts = t.alarms.select("logdate", "logid"), actions(t)
    # each delivery of actions comes before the alarms of its time, and at last rows of either long after all others;
    # there is a row of either in every delivery
    def end_of(df, ts, *days):
        return [closed(df, ts, n, logid="~") for n in days]

    a_parts = [*end_of(own, "logdate", 0), *by_time(own, "logdate"), *end_of(own, "logdate", 60, 120)]
    d_parts = [*by_time(acts, "action_ts"), *end_of(acts, "action_ts", 0, 60, 120)]
    read = lambda df, path: t.spark.readStream.schema(df.schema).parquet(path)
    for a, d in itertools.zip_longest(a_parts, d_parts):
        for part, path in ((a, births), (d, asked)):
            if part is not None:
                part.write.mode("append").parquet(path)
        got = jobs.run_available(ordered.lifecycle_stream(read(own, births), read(acts, asked), "30 days"), "births", out=out, checkpoint=ckpt)
    return got.where("reason IS NOT NULL AND logid <> '~'").select("logid", "logdate", "action_id", "action", "reason")


ORACLES["sm7_lifecycle_births_stream"] = ORACLES["sm7_lifecycle_stream"]


@query("sm8_detect_alarms_stream")
def _(t):
    out = scratch_path(t.spark, "raised")
    jobs.run_batches(stream_of(t, "events", "tele"), jobs.alarm_writer(t.spark, out, _ALL))
    return t.spark.read.parquet(f"{out}/batch=*").select("errorcode", "equipmentid", "process", "related_log_id", "link_basis")


ORACLES["sm8_detect_alarms_stream"] = f"SELECT errorcode, equipmentid, process, related_log_id, link_basis FROM ({ORACLES['sm8_detect_alarms']})"


@query("sm9_link_alarms_stream")
def _(t):
    tele, out = scratch_path(t.spark, "tele"), scratch_path(t.spark, "linked")
    t.tele.select("time", "eqp_id", "log_id").write.parquet(tele)
    writer = jobs.link_writer(tele, out, "2 hours")
    deliver(t, by_time(t.alarms, "logdate", 2), "alarms", lambda source, ckpt: jobs.run_batches(source, writer, ckpt))
    return t.spark.read.schema(t.alarms.schema).parquet(f"{out}/linked/batch=*").select("logid", "related_log_id", "link_basis")


ORACLES["sm9_link_alarms_stream"] = ORACLES["sm9_link_alarms"]


def late_links(t: Tables, cuts: int) -> DataFrame:
    """Alarms delivered in `cuts` stretches, each before the telemetry of its time is there."""
    tele, out = scratch_path(t.spark, "tele"), scratch_path(t.spark, "linked")
    rows = t.tele.select("time", "eqp_id", "log_id")
    writer = jobs.link_writer(tele, out, "2 hours", "1 hour")
    slices = by_time(rows, "time", cuts)
    rows.limit(0).write.parquet(tele)
    arrivals = iter([None, *slices])

    def run(source: DataFrame, ckpt: str) -> None:
        part = next(arrivals)
        if part is not None:
            part.write.mode("append").parquet(tele)
        jobs.run_batches(source, writer, ckpt)

    deliver(t, by_time(t.alarms, "logdate", cuts), "alarms", run)
    slices[-1].unionByName(closed(rows, "time")).write.mode("append").parquet(tele)
    jobs.settle_links(t.spark, writer, out)
    return t.spark.read.schema(t.alarms.schema).parquet(f"{out}/linked/batch=*").select("logid", "related_log_id", "link_basis")


@query("sm9_link_late_stream")
def _(t):
    return late_links(t, 3)


ORACLES["sm9_link_late_stream"] = ORACLES["sm9_link_alarms"]


@query("sm9_link_nearest_stream")
def _(t):
    tele, alarms, ckpt, out = (scratch_path(t.spark, x) for x in ("tele", "alarms", "nearest-ckpt", "nearest"))
    rows, own = t.tele.select("time", "eqp_id", "log_id"), t.alarms
    # each delivery of alarms comes before its telemetry, and at last rows of either long after all others: the first
    # lets the join go of what waits in it, the second the choice among what was joined
    a_parts = [*by_time(own, "logdate"), *(closed(own, "logdate", days, logid="~") for days in (60, 120))]
    d_parts = [rows.limit(0), *by_time(rows, "time"), *(closed(rows, "time", days, eqp_id="~") for days in (60, 120))]
    for a, d in itertools.zip_longest(a_parts, d_parts):
        for part, path in ((a, alarms), (d, tele)):
            if part is not None:
                part.write.mode("append").parquet(path)
        read = lambda df, path: t.spark.readStream.schema(df.schema).parquet(path)
        got = jobs.run_available(jobs.nearest_stream(read(own, alarms), read(rows, tele), "2 hours", "1 day"), "nearest", out=out, checkpoint=ckpt)
    return got.where("logid <> '~'").select("logid", "related_log_id", "link_basis")


ORACLES["sm9_link_nearest_stream"] = f"SELECT * FROM ({ORACLES['sm9_link_alarms']}) WHERE link_basis IS DISTINCT FROM 'causal'"


@query("sm10_sustained_stream", "tele", f"WITH {SUSTAINED_SQL}")
def _(t):
    return streamed(t, by_time(evaluations(t), "ts"), "sustained", lambda s: jobs.sustained_stream(s, "key", "3 hours", "1 hour"))


@query("sm11_notifications_stream")
def _(t):
    rows = alert_changes(t)
    parts = [*by_time(rows, "ts"), closed(rows, "ts", device_id="~", alertname="Watchdog")]
    out = streamed(t, parts, "notifications", ordered.notifications_stream)
    return out.where((F.col("device_id") != "~") & (F.col("ts") <= fn.ts_lit(AS_OF)))


ORACLES["sm11_notifications_stream"] = ORACLES["sm11_notifications"]


@query("sm12_rate_stream", "", f"WITH {RESETTING_SQL} SELECT key, bucket, {r('rate', 4)} AS rate FROM rt")
def _(t):
    rows = readings(t)
    parts = [*by_time(rows, "ts"), closed(rows, "ts", key="~")]
    return streamed(t, parts, "rates", lambda s: ordered.rate_stream(s, ["key"], "ts", "v", "6 hours", keep="50 days")).where("key <> '~'").withColumn("rate", fn.rnd("rate", 4))


@query("sm13_lateness_stream", "tele", "SELECT 'accepted' AS verdict, count(*) AS n FROM tele UNION ALL SELECT 'quarantined', count(*) FROM tele WHERE time < (SELECT max(time) - INTERVAL 10 DAY FROM tele)")
def _(t):
    rows, out = t.tele.select("time", "log_id"), scratch_path(t.spark, "late")
    newest = rows.agg(F.max("time")).scalar()
    old = rows.where(F.col("time") < fn.ts_plus(newest, -fn.interval_us("10 days")))
    # the whole table, then its old part again: the second delivery is late
    writer = jobs.lateness_writer(out, "time", "10 days")
    deliver(t, [rows, old], "late", lambda source, ckpt: jobs.run_batches(source, writer, ckpt))
    parts = [t.spark.read.parquet(f"{out}/{d}/batch=*").agg(F.lit(v).alias("verdict"), F.count(F.lit(1)).alias("n")) for d, v in (("accepted", "accepted"), ("quarantine", "quarantined"))]
    return parts[0].unionByName(parts[1])


@query("src1_ingest_telemetry_stream", "tele", _INGESTED)
def _(t):
    return _ingested(streamed(t, [telemetry_json(t)], "ingested", ingest.ingest_telemetry))


@query("src5_dedupe_stream", "alarms", "SELECT logid, logdate FROM alarms")
def _(t):
    rows = t.alarms.select("logid", "logdate")
    # delivered with duplicates, and then once more
    return streamed(t, [rows.unionByName(rows), rows], "deduped", lambda s: jobs.dedupe_stream(s, ["logdate", "logid"], "logdate", _ALL))
