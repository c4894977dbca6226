"""Streaming counterparts of the batch operators.

Windowed work uses watermarks and built-in aggregations. State per key is a few scalars a key, a bucket of keys to a call
(`keyed`). Work that needs the stored history runs in foreachBatch on the batch operators.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeutil import interval_us, time_bucket, ts_lit, ts_plus
from ..operators.alarms import link_alarms
from ..operators.infra import rates_between_polls, with_octets
from ..operators.rollup import Spec, reaggregate, rollup
from ..operators.snapshot import detect_alarms
from ..session import scratch_path
from ..sources.maintenance import batch_numbers
from .keyed import _NO_TIME, each_key, last_nulls


def run_available(stream: DataFrame, label: str, mode: str = "append", out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process everything available into a Parquet table and return that table.

    The checkpoint and the table lie in the shared folder, so a lost executor or a restart resumes from them.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out)
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"{label}-ckpt")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """foreachBatch over everything available."""
    spark = stream.sparkSession
    ckpt = checkpoint or scratch_path(spark, "batches-ckpt")
    stream.writeStream.foreachBatch(fn).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()


def stream_rollup(df: DataFrame, ts: str, width: str, watermark: str, keys: list[str], spec: Spec, start: str = "0 seconds") -> DataFrame:
    """Tumbling event-time rollup: a bucket closes once the watermark (the re-open allowance) has passed it."""
    aggs = [getattr(F, fn)(c).alias(n) for n, (fn, c) in spec.items()]
    out = df.withWatermark(ts, watermark).groupBy(F.window(ts, width, startTime=start).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("sample_count"), *aggs)
    return out.select(F.col("_w.start").alias("bucket"), *keys, "sample_count", *spec)


def cascade_writer(root: str, ts: str, keys: list[str], spec: Spec, widths: list[str], mode: str = "weighted") -> Callable[[DataFrame, int], None]:
    """foreachBatch function that keeps a chain of rollup tables up to date.

    Raw rows go to a directory named after the batch, so a retried batch replaces itself. Only the periods (days, or the
    widest bucket if that is longer) a batch touches are recomputed, each tier from the one below it.
    """
    period_width = max(["1 day", *widths], key=interval_us)

    def period(c: str) -> Column:
        return F.to_date(time_bucket(c, period_width)).alias("period")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        raw = f"{root}/raw"
        batch.select("*", period(ts)).write.mode("overwrite").partitionBy("period").parquet(f"{raw}/batch={batch_id}")
        # a batch touches few periods; as literals they prune the directories of both tables
        touched = [r.period for r in spark.read.parquet(f"{raw}/batch={batch_id}").select("period").distinct().collect()]
        inside = F.col("period").isin(touched) if touched else F.lit(False)
        rows = spark.read.option("basePath", raw).parquet(f"{raw}/batch=*").where(inside)
        tier = rollup(rows, ts, widths[0], keys, spec)
        for i, width in enumerate(widths):
            if i:
                tier = reaggregate(tier, width, keys, spec, mode)
            target = f"{root}/{width.replace(' ', '_')}"
            tier.select("*", period("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(target)
            tier = spark.read.parquet(target).where(inside).drop("period")

    return write


def dedupe_stream(df: DataFrame, keys: list[str], ts: str, watermark: str) -> DataFrame:
    """First row per key; state of a key is dropped after the watermark."""
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def assemble_cycle(parts: DataFrame, timeout: str = "35 seconds", ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """One row per device and poll cycle from the readings of its walkers; a cycle ends `timeout` after its last part.

    Works on batch and streaming input (with `watermark`).
    """
    src = parts.withWatermark(ts, watermark) if watermark else parts
    cols = [c for c in parts.columns if c not in ("device_id", ts, "walker")]
    seen = F.sort_array(F.collect_set("walker"))
    return (
        src.groupBy("device_id", F.session_window(ts, timeout).alias("_s"))
        .agg(F.max(ts).alias("last_part"), seen.alias("walkers"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in cols])
        .select("device_id", F.col("_s.start").alias("cycle_start"), "last_part", "walkers", *cols)
    )


def debounce_stream(alarms: DataFrame, cooldown: str = "12 minutes", watermark: str | None = None) -> DataFrame:
    """Fired alarms only, with when their (machine, code) first fired and how often it has.

    The state of a key is its first and last firing and their count. With a `watermark` it is dropped a cooldown after
    the last firing: the next alarm fires in any case, and counts anew.
    """
    us = interval_us(cooldown)

    def each(key: tuple, came: list[tuple], state: tuple | None, now_ms: int) -> tuple[tuple | None, list[tuple], int | None]:
        if not came:
            return None, [], None
        came.sort(key=lambda r: last_nulls(r, (0, 1)))
        first, last, count = state or (None, None, 0)
        times, fired = [_NO_TIME if t is None else t for t, _ in came], []
        i = 0 if last is None else bisect_left(times, last + us)
        while i < len(times):
            last, count = times[i], count + 1
            first = last if first is None else first
            fired.append((*came[i], count))
            i = bisect_left(times, last + us)
        emitted = [(t, logid, first, n) for t, logid, n in fired]
        return (first, last, count), emitted, max((last + us) // 1000, now_ms) + 1 if watermark else None

    rows = alarms.select("equipmentid", "errorcode", "logdate", "logid")
    rows = rows.withWatermark("logdate", watermark) if watermark else rows
    out = {"logdate": "timestamp", "logid": "string", "first_fired": "timestamp", "fire_count": "bigint"}
    return each_key(rows, ["equipmentid", "errorcode"], ["logdate", "logid"], each, out, timed=bool(watermark))


def counter_rate_stream(counters: DataFrame) -> DataFrame:
    """Interface rates as the batch operator computes them; the state of a device is its last poll.

    State adds to each row the counters of the poll before; everything after that is built-in expressions.
    """
    names = ["device_id", "iface", "ts", "name", "status", "errors", "drops"]
    rows = with_octets(counters).select(*names, F.col("_rx").cast("string").alias("_rx"), F.col("_tx").cast("string").alias("_tx"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    read = [*names[1:], "_rx", "_tx"]

    def each(key: tuple, came: list[tuple], state: tuple | None, now_ms: int) -> tuple[tuple | None, list[tuple], int | None]:
        came.sort(key=lambda r: last_nulls(r, (1, 0)))
        held_at, held = state or (None, {})
        polls: dict[int, list[tuple]] = {}
        for r in came:
            polls.setdefault(r[1], []).append(r)
        # a row without a time belongs to no poll
        emitted = [(*r, None, None, None) for r in polls.pop(None, [])]
        before, seen = None, {}
        for at in sorted({*polls, held_at} - {None}):
            # the poll held from earlier batches may get more rows, or others may come late before it
            now_seen = dict(held) if at == held_at else {}
            for r in polls.get(at, []):
                now_seen.setdefault(r[0], (r[-2], r[-1]))
                dt = None if before is None else (at - before) / 1e6
                emitted.append((*r, *seen.get(r[0], (None, None)), dt))
            before, seen = at, now_seen
        return (before, seen), emitted, None

    out = {**{n: types[n] for n in names[1:]}, "_rx": "string", "_tx": "string", "_prx": "string", "_ptx": "string", "_dt": "double"}
    polled = each_key(rows, ["device_id"], read, each, out, timed=False)
    return rates_between_polls(polled.withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("_rx", "_tx", "_prx", "_ptx")}))


def carry_forward_stream(df: DataFrame, key: str, ts: str, tie: str, cols: list[str]) -> DataFrame:
    """Fill NULL readings with the key's last known value; the state of a key is one value per column."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def each(k: tuple, came: list[tuple], state: list | None, now_ms: int) -> tuple[list | None, list[tuple], int | None]:
        came.sort(key=lambda r: last_nulls(r, (0, 1)))
        known, emitted = state or [None] * len(cols), []
        for r in came:
            known = [old if v is None else v for v, old in zip(r[2:], known)]
            emitted.append((*r[:2], *known))
        return known, emitted, None

    names = [ts, tie, *cols]
    return each_key(df.select(key, *names), [key], names, each, {n: types[n] for n in names}, timed=False)


def lifecycle_stream(actions: DataFrame, watermark: str | None = None, keep: str = "30 days") -> DataFrame:
    """Every action with the state it led to, or the reason it was rejected; the state of an alarm is its status.

    With a `watermark` an alarm that is RESOLVED is forgotten `keep` after its last action: what comes later still is
    taken as an action on an unknown, open alarm.
    """
    us = interval_us(keep)
    allowed = {"ACKNOWLEDGED": {"OPEN"}, "RESOLVED": {"OPEN", "ACKNOWLEDGED"}}

    def each(key: tuple, came: list[tuple], status: str | None, now_ms: int) -> tuple[str | None, list[tuple], int | None]:
        if not came:
            return None, [], None
        came.sort(key=lambda r: last_nulls(r, (0, 1)))
        status, emitted = status or "OPEN", []
        for _, action_id, action, actor in came:
            reason = None
            if status == "RESOLVED":
                reason = "RESOLVED is final"
            elif action not in allowed:
                reason = f"no transition to {action}"
            elif not (actor or "").strip():
                reason = "actor required"
            elif status not in allowed[action]:
                reason = "not OPEN"
            if reason is None:
                status = action
            emitted.append((action_id, action, status, reason))
        over = watermark and status == "RESOLVED" and came[-1][0] is not None
        return status, emitted, max((came[-1][0] + us) // 1000, now_ms) + 1 if over else None

    rows = actions.withWatermark("action_ts", watermark) if watermark else actions
    rows = rows.select("logdate", "logid", "action_ts", "action_id", "action", "actor")
    out = {"action_id": "string", "action": "string", "status": "string", "reason": "string"}
    told = each_key(rows, ["logdate", "logid"], ["action_ts", "action_id", "action", "actor"], each, out, timed=bool(watermark))
    return told.select("logid", "logdate", *out)


def sustained_stream(evals: DataFrame, key: str, hold: str, step_width: str) -> DataFrame:
    """ok / pending / firing per evaluation (key, ts, cond); the state of a key is when its run began and its last time."""
    run, grid = interval_us(hold), interval_us(step_width)

    def each(k: tuple, came: list[tuple], state: tuple | None, now_ms: int) -> tuple[tuple | None, list[tuple], int | None]:
        came.sort(key=lambda r: last_nulls(r, (0,)))
        since, seen = state or (None, None)
        emitted = []
        for ts, cond in came:
            t = _NO_TIME if ts is None else ts
            if not cond:
                since = None
            elif since is None or t - seen > grid:
                since = t
            seen = t
            emitted.append((ts, cond, "ok" if not cond else "firing" if t - since >= run else "pending"))
        return (since, seen), emitted, None

    out = {"ts": "timestamp", "cond": "boolean", "state": "string"}
    return each_key(evals.select(key, "ts", "cond"), [key], ["ts", "cond"], each, out, timed=False)


def alarm_writer(spark: SparkSession, alarm_path: str, window: str = "3 minutes") -> Callable[[DataFrame, int], None]:
    """foreachBatch: raise alarms from the newest row of each machine of the batch, as of the batch's newest time."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max("time").cast("string")).first()[0]
        if newest is not None:
            detect_alarms(batch, newest, window).write.mode("overwrite").parquet(f"{alarm_path}/batch={batch_id}")

    return write


def link_writer(tele_path: str, out: str, tol: str = "2 minutes", allowance: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch: link alarms to stored telemetry; rejected alarms are kept apart.

    The nearest row is looked for among the telemetry around the batch's times, cut down to the (machine, time bucket)
    groups the batch needs; a given id may be any stored row's. With an `allowance` an alarm waits until telemetry has
    come that is newer than it by `tol` and the allowance, so the result does not depend on which batch it came in or on
    telemetry that is late; what waits is handed from batch to batch. `settle_links` works on it without a new alarm.
    """
    us = interval_us(tol)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tele = spark.read.parquet(tele_path)
        before = [n for n in batch_numbers(spark, f"{out}/waiting") if n < batch_id] if allowance else []
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{out}/waiting/batch={before[-1]}")) if before else batch
        if allowance:
            newest = tele.agg(F.unix_micros(F.max("time"))).first()[0]
            ready = F.unix_micros("logdate") + us + interval_us(allowance) <= F.lit(newest).cast("long")
            ready = F.coalesce(ready, F.col("logdate").isNull())
            rows.where(~ready).write.mode("overwrite").parquet(f"{out}/waiting/batch={batch_id}")
            rows = rows.where(ready)
        first, last = rows.agg(F.min("logdate").cast("string"), F.max("logdate").cast("string")).first()
        near = F.col("time").between(ts_plus(ts_lit(first), -us), ts_plus(ts_lit(last), us)) if first is not None else F.lit(False)
        linked, rejected = link_alarms(rows, tele.where(near), tol, ids=tele)
        linked.write.mode("overwrite").parquet(f"{out}/linked/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{out}/rejected/batch={batch_id}")

    return write


def settle_links(spark: SparkSession, write: Callable[[DataFrame, int], None], out: str) -> None:
    """Run a `link_writer` on what waits, when telemetry has come but no alarm; its batch follows all that are there."""
    known = batch_numbers(spark, f"{out}/waiting")
    if known:
        waiting = spark.read.parquet(f"{out}/waiting/batch={known[-1]}")
        write(waiting.limit(0), known[-1] + 1)


def nearest_stream(alarms: DataFrame, tele: DataFrame, tol: str = "2 minutes", watermark: str = "5 minutes") -> DataFrame:
    """Alarms without an id beside the telemetry row nearest in time within `tol`, both sides streams.

    An interval join with watermarks on both sides, then the nearest of each alarm's rows once nothing nearer can come.
    """
    a = alarms.where(F.col("related_log_id").isNull()).select("logid", "logdate", "equipmentid").withWatermark("logdate", watermark)
    d = tele.select("time", "eqp_id", "log_id").withWatermark("time", watermark)
    close = (F.col("eqp_id") == F.col("equipmentid")) & (F.col("time") >= F.col("logdate") - F.expr(f"INTERVAL {tol}")) & (F.col("time") <= F.col("logdate") + F.expr(f"INTERVAL {tol}"))
    met = a.join(d, close, "left_outer")
    apart = F.struct(F.abs(F.unix_micros("time") - F.unix_micros("logdate")).alias("us"), "time", "log_id")
    near = met.groupBy("logdate", "logid", "equipmentid").agg(F.min(F.when(F.col("log_id").isNotNull(), apart)).alias("n"))
    return near.select("logid", "logdate", "equipmentid", F.col("n")["log_id"].alias("related_log_id"), F.when(F.col("n").isNotNull(), "nearest").alias("link_basis"))


def lateness_writer(out: str, ts: str, allowance: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: rows older than the newest time seen so far minus the allowance go to quarantine, the rest through.

    Each batch leaves one mark, the newest time up to and with it, and reads only the mark before it.
    """
    us = interval_us(allowance)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = f"{out}/marks"
        before = [n for n in batch_numbers(spark, marks) if n < batch_id]
        seen = spark.read.parquet(f"{marks}/batch={before[-1]}").first()[0] if before else None
        late = F.lit(False) if seen is None else F.unix_micros(ts) < F.lit(seen - us)
        batch.where(late).write.mode("overwrite").parquet(f"{out}/quarantine/batch={batch_id}")
        batch.where(~late).write.mode("overwrite").parquet(f"{out}/accepted/batch={batch_id}")
        batch.agg(F.greatest(F.max(F.unix_micros(ts)), F.lit(seen).cast("long")).alias("us")).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")

    return write

