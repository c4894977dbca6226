"""Streams over several micro-batches must end where the batch operator ends, and close windows by watermark."""
from helpers import alarms, at, rows
from test_alarms import ITEMS, REASONS, actions

from tallyforge.operators import alarms as al
from tallyforge.session import scratch_path
from tallyforge.streaming import jobs, ordered


def stream(spark, df, slices, ts):
    """One file per slice of rows in time order."""
    path = scratch_path(spark, "s-in")
    data = df.orderBy(ts).collect()
    n = -(-len(data) // slices)
    for i in range(slices):
        spark.createDataFrame(data[i * n : (i + 1) * n], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_debounce_state_survives_batches(spark):
    a = alarms(spark, [{"logdate": at(60 * i)} for i in range(40)]).select("equipmentid", "errorcode", "logdate", "logid")
    got = rows(jobs.run_available(jobs.debounce_stream(stream(spark, a, 4, "logdate")), "s-deb"), "logid")
    want = rows(al.debounce(a).where("fired"), "logid")
    assert [r["logid"] for r in got] == [r["logid"] for r in want]


def test_lifecycle_stream_rejects_like_batch(spark):
    got = {r["action_id"]: r["reason"] for r in rows(jobs.run_available(jobs.lifecycle_stream(stream(spark, actions(spark, ITEMS), 3, "action_ts")), "s-life")) if r["reason"]}
    # a stream of actions cannot tell that an alarm is unknown
    assert got == {k: v for k, v in REASONS.items() if v != "unknown alarm"}


def test_rollup_closes_by_watermark(spark):
    df = spark.createDataFrame([("k", at(t), float(t)) for t in (0, 10, 70, 65, 20, 400, 410, 5)], "k string, ts timestamp, v double")
    path = scratch_path(spark, "s-late")
    for r in df.collect():
        spark.createDataFrame([r], df.schema).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = rows(jobs.run_available(jobs.stream_rollup(src, "ts", "1 minute", "2 minutes", ["k"], {"top": ("max", "v")}), "s-roll"), "bucket")
    # a batch is filtered with the watermark the batch before it ran with. 20 s arrives inside the allowance and counts; 5 s arrives after its bucket was closed and does not
    assert [(r["bucket"], r["sample_count"], r["top"]) for r in got] == [(at(0), 3, 20.0), (at(60), 2, 70.0)]


def test_restart_resumes(spark):
    a = alarms(spark, [{"logdate": at(60 * i)} for i in range(30)]).select("equipmentid", "errorcode", "logdate", "logid")
    path, out, ckpt = (scratch_path(spark, x) for x in ("s-r", "s-o", "s-c"))
    a.where(f"logdate < timestamp'{at(600)}'").coalesce(1).write.parquet(path)
    src = lambda: spark.readStream.schema(a.schema).parquet(path)
    jobs.run_available(jobs.debounce_stream(src()), "x", out=out, checkpoint=ckpt)
    a.where(f"logdate >= timestamp'{at(600)}'").coalesce(1).write.mode("append").parquet(path)
    got = jobs.run_available(jobs.debounce_stream(src()), "x", out=out, checkpoint=ckpt)
    assert sorted(r["logdate"] for r in rows(got)) == [at(0), at(720), at(1440)]


def last_state(spark, df):
    q = df.writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "s-ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.lastProgress["stateOperators"][0]["numRowsTotal"]


def one_alarm_each(spark, n):
    return alarms(spark, [{"errorcode": str(i), "logdate": at(600 * i)} for i in range(n)]).select("equipmentid", "errorcode", "logdate", "logid")


def test_debounce_forgets_keys_after_the_cooldown(spark):
    a = one_alarm_each(spark, 60)
    assert last_state(spark, jobs.debounce_stream(stream(spark, a, 6, "logdate"), watermark="1 minute")) < 30
    assert last_state(spark, jobs.debounce_stream(stream(spark, a, 6, "logdate"))) == 60


def test_debounce_with_expiry_fires_like_batch_and_counts(spark):
    a = alarms(spark, [{"logdate": at(60 * i)} for i in range(60)]).select("equipmentid", "errorcode", "logdate", "logid")
    got = rows(jobs.run_available(jobs.debounce_stream(stream(spark, a, 6, "logdate"), watermark="1 minute"), "s-deb"), "logdate")
    assert [r["logid"] for r in got] == [r["logid"] for r in rows(al.debounce(a).where("fired"), "logdate")]
    assert [r["fire_count"] for r in got] == [1, 2, 3, 4, 5] and {r["first_fired"] for r in got} == {at(0)}


def test_lifecycle_forgets_resolved_alarms(spark):
    ddl = "logid string, logdate timestamp, action_id string, action string, actor string, action_ts timestamp"
    items = [(f"A{i}", at(0), f"{i}", "RESOLVED", "me", at(3600 * i)) for i in range(40)]
    df = spark.createDataFrame(items, ddl)
    assert last_state(spark, jobs.lifecycle_stream(stream(spark, df, 5, "action_ts"), watermark="1 minute", keep="1 hour")) < 25


def test_actions_on_unknown_alarms_are_told_apart(spark):
    acts = actions(spark, ITEMS)
    known = acts.select("logdate", "logid").distinct().where("logid <> 'nope'")
    last = acts.limit(1).selectExpr(*[f"CAST('2030-01-01' AS timestamp) AS {c}" if c in ("logdate", "action_ts") else f"'~' AS {c}" for c in acts.columns])
    unknown = {k for k, v in REASONS.items() if v == "unknown alarm"}
    born = known.join(acts.where(acts["action_id"].isin(list(unknown))).select("logdate", "logid"), ["logdate", "logid"], "left_anti")
    born = born.unionByName(last.select("logdate", "logid"))
    for cuts in (1, 3):
        out = jobs.run_available(ordered.lifecycle_stream(stream(spark, born, cuts, "logdate"), stream(spark, acts.unionByName(last), 4 - cuts, "action_ts"), "1 day"), "s-births")
        got = {r["action_id"]: r["reason"] for r in rows(out) if r["reason"] and r["action_id"] != "~"}
        assert got == REASONS
