"""What a device shows between walks, in chunks and as a stream."""
import random

import pytest
from helpers import at, frame, rows

from tallyforge.session import scratch_path
from tallyforge.sources.varbinds import device_state, whole_walks
from tallyforge.streaming.jobs import run_available
from tallyforge.streaming.ordered import device_state_stream

WALK = "device_id string, ts timestamp, walker string, oid string, value string"
CPU, TEMP, PE1, PE2, ST = "1.3.6.1.2.1.25.3.3.1.2.1", "1.3.6.1.4.1.2021.13.16.2.1.7.1", "1.3.6.1.4.1.9999.1.4.2", "1.3.6.1.4.1.9999.1.4.5", "1.3.6.1.2.1.25.2.3.1."


def walk(t, walker, *readings, device="d"):
    return [{"device_id": device, "ts": at(t), "walker": walker, "oid": o, "value": str(v)} for o, v in readings]


def entry(i, kind, au, size, used):
    return [(f"{ST}{p}.{i}", v) for p, v in (("2", kind), ("4", au), ("5", size), ("6", used))]


def story():
    return [
        *walk(0, "temp", (TEMP, 40)), *walk(1, "cpu", (CPU, 30)), *walk(2, "storage", *entry(1, "hrStorageRam", 1048576, 4000, 1000), *entry(2, "disk", 1073741824, 50, 20)),
        *walk(30, "temp", (TEMP, 35)), *walk(31, "cpu", ("1.2.3", 5)), *walk(32, "storage", *entry(2, "disk", 1073741824, 60, 30)),
        *walk(60, "storage", *entry(9, "", 0, 0, 0)), *walk(61, "ldi", (PE1, 1000), (PE2, 200)), *walk(62, "ldi", (PE1, 400)), *walk(63, "temp", (TEMP, -5)),
    ]


def shown(df):
    cols = ("ts", "cpu_load_percent", "temp_c", "ram_total_mb", "ram_used_mb", "disk_total_gb", "disk_used_gb", "pe")
    return [tuple(r[c] for c in cols) for r in rows(df, "device_id", "ts", "walker")]


WANT = [
    (at(0), 0.0, 40.0, 0.0, 0.0, 0.0, 0.0, 0.0), (at(1), 30.0, 40.0, 0.0, 0.0, 0.0, 0.0, 0.0), (at(2), 30.0, 40.0, 4000.0, 1000.0, 50.0, 20.0, 0.0),
    (at(30), 30.0, 40.0, 4000.0, 1000.0, 50.0, 20.0, 0.0), (at(31), 30.0, 40.0, 4000.0, 1000.0, 50.0, 20.0, 0.0), (at(32), 30.0, 40.0, 4000.0, 1000.0, 60.0, 30.0, 0.0),
    (at(60), 30.0, 40.0, 4000.0, 1000.0, 60.0, 30.0, 0.0), (at(61), 30.0, 40.0, 4000.0, 1000.0, 60.0, 30.0, 6.0), (at(62), 30.0, 40.0, 4000.0, 1000.0, 60.0, 30.0, 5.0),
    (at(63), 30.0, 40.0, 4000.0, 1000.0, 60.0, 30.0, 5.0),
]


@pytest.mark.parametrize("size", [1, 3, None])
def test_what_a_walk_does_not_tell_stays(spark, size):
    assert shown(device_state(frame(spark, WALK, story()), size)) == WANT


def test_a_storage_walk_without_any_entry_shows_ones(spark):
    got = shown(device_state(frame(spark, WALK, walk(0, "storage", *entry(1, "", 0, 0, 0)))))
    assert got == [(at(0), 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0)]


@pytest.mark.parametrize("cuts, lag", [([4], 0), ([2, 3, 7, 9], 20)])
def test_the_stream_shows_the_same_however_it_is_cut(spark, cuts, lag):
    rng = random.Random(1)
    items = story() + walk(5, "cpu", (CPU, 80), device="e") + walk(9000, "cpu", (CPU, 1), device="~")
    walks = whole_walks(frame(spark, WALK, items))
    data = sorted(walks.collect(), key=lambda r: (r["ts"].timestamp() + rng.uniform(0, lag)))
    path = scratch_path(spark, "walks")
    for a, b in zip([0, *cuts], [*cuts, len(data)]):
        spark.createDataFrame(data[a:b], walks.schema).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(walks.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run_available(device_state_stream(source), "states")
    assert shown(got.where("device_id = 'd'")) == WANT
    assert shown(got.where("device_id = 'e'"))[0][1] == 80.0
