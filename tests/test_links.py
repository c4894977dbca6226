"""Streamed linking must not depend on how alarms are cut into batches, nor on telemetry that arrives late."""
import pytest
from helpers import alarms, at, rows, telemetry

from tallyforge.operators import alarms as al
from tallyforge.session import scratch_path
from tallyforge.streaming import jobs

TELE = ["time", "eqp_id", "log_id"]


def story(spark):
    tele = telemetry(spark, [{"log_id": f"L{i}", "time": at(60 * i)} for i in range(30)]).select(*TELE)
    given = [{"logdate": at(600), "related_log_id": "L0"}, {"logdate": at(60), "related_log_id": None}, {"logdate": at(900), "related_log_id": "nope"}, {"logdate": at(601), "related_log_id": None}, {"logdate": at(605), "related_log_id": "L29"}]
    ddl = "logid string, logdate timestamp, equipmentid string, related_log_id string, link_basis string"
    return tele, spark.createDataFrame([(f"A{i}", r["logdate"], "M1", r["related_log_id"], None) for i, r in enumerate(given)], ddl)


def outcome(spark, out):
    read = lambda d: {(r["logid"], r["related_log_id"], r["link_basis"]) for r in rows(spark.read.parquet(f"{out}/{d}/batch=*"))}
    return read("linked"), read("rejected")


@pytest.mark.parametrize("batches", [[[0], [1, 2], [3, 4]], [[0, 1, 2, 3, 4]], [[4], [3], [2], [1], [0]]])
def test_given_ids_are_checked_against_all_telemetry(spark, batches):
    tele, own = story(spark)
    path, out = scratch_path(spark, "tele"), scratch_path(spark, "out")
    tele.write.parquet(path)
    write = jobs.link_writer(path, out)
    for n, ids in enumerate(batches):
        write(own.where(own["logid"].isin([f"A{i}" for i in ids])), n)
    linked, rejected = outcome(spark, out)
    want = al.link_alarms(own, tele)
    assert linked == {(r["logid"], r["related_log_id"], r["link_basis"]) for r in rows(want[0])}
    assert {r[0] for r in rejected} == {"A2"}


@pytest.mark.parametrize("cut", [1, 2, 4])
def test_alarms_wait_for_telemetry_that_is_late(spark, cut):
    tele, own = story(spark)
    path, out = scratch_path(spark, "tele"), scratch_path(spark, "out")
    items = sorted(own.collect(), key=lambda r: r["logid"])
    tele.where("log_id = 'L0'").write.parquet(path)
    write = jobs.link_writer(path, out, allowance="1 minute")
    for n, part in enumerate([items[:cut], items[cut:]]):
        write(spark.createDataFrame(part, own.schema), n)
    tele.where("log_id <> 'L0'").write.mode("append").parquet(path)
    jobs.settle_links(spark, write, out)
    linked, rejected = outcome(spark, out)
    assert linked == {(r["logid"], r["related_log_id"], r["link_basis"]) for r in rows(al.link_alarms(own, tele)[0])}
    assert {r[0] for r in rejected} == {"A2"}
    write(own.limit(0), 2)  # a batch that is run again replaces itself
    assert outcome(spark, out)[0] == linked
