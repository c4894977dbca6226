"""Device walks (device, ts, walker, oid, value) turned into metric rows by conditional aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize_oid, rnd
from ..operators.machines import Machine, in_chunks
from ..operators.recurrences import HalfAverage, LastKnown, Together, half_average

# Object identifiers of the supported tables.
CPU_OIDS = ("1.3.6.1.2.1.25.3.3.1.2.", "1.3.6.1.4.1.2636.3.1.13.1.8.")
TEMP_OIDS = ("1.3.6.1.4.1.2021.13.16.2.1.7.", "1.3.6.1.4.1.2636.3.1.13.1.7.")
STORAGE_OID = "1.3.6.1.2.1.25.2.3.1."
IF_TABLE = r"1\.3\.6\.1\.2\.1\.2\.2\.1\.(\d+)\.(\d+)$"
IFX_TABLE = r"1\.3\.6\.1\.2\.1\.31\.1\.1\.1\.(\d+)\.(\d+)$"
MACHINE_OIDS = {
    "1.3.6.1.4.1.9999.1.1.0": ("throughput", 1),
    "1.3.6.1.4.1.9999.1.2.0": ("temperature", 100),
    "1.3.6.1.4.1.9999.1.3.0": ("humidity", 100),
    "1.3.6.1.4.1.9999.1.4.2": ("pe", 100),
    "1.3.6.1.4.1.9999.1.4.5": ("pe", 100),
    "1.3.6.1.4.1.9999.1.5.1": ("je", 100),
    "1.3.6.1.4.1.9999.1.6.1": ("power_watt", 1),
    "1.3.6.1.4.1.9999.1.7.1": ("vibration", 100),
}
# Words and byte ranges by which a storage entry is told to be RAM or disk.
RAM_TYPES = r"ram|virtual|memory|25\.2\.1\.2|25\.2\.1\.3"
DISK_TYPES = r"disk|flash|fixed|storage|25\.2\.1\.4"
# a storage entry without a known type in this byte range is taken for RAM
RAM_MIN, RAM_MAX = 100_000_000, 8_000_000_000
CAP = 1048576.0


def _rows(varbinds: DataFrame, walker: str) -> DataFrame:
    rows = varbinds.where((F.col("walker") == walker) & F.col("oid").isNotNull())
    number = F.coalesce(F.expr("try_cast(value as double)"), F.lit(0.0))
    return rows.withColumns({"oid": normalize_oid("oid"), "_num": number})


def _starts(prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.col("oid").startswith(p)
    return out


def _last_part() -> Column:
    return F.element_at(F.split("oid", r"\."), -1)


def cpu_metrics(varbinds: DataFrame) -> DataFrame:
    """Core count, mean load in 0..100, and load per core."""
    rows = _rows(varbinds, "cpu").where(_starts(CPU_OIDS))
    per_core = rows.groupBy("device_id", "ts", F.concat(F.lit("core_"), _last_part()).alias("core")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_num").alias("s"), F.max("_num").alias("v")
    )
    load = rnd(F.sum("s") / F.sum("n"), 2)
    # one entry per core of one device and poll
    cores = F.map_from_entries(F.array_sort(F.collect_list(F.struct("core", "v"))))
    return per_core.groupBy("device_id", "ts").agg(
        F.sum("n").cast("int").alias("cpu_cores"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), load)).alias("cpu_load_percent"),
        cores.alias("cpu_metrics"),
    )


def temp_metrics(varbinds: DataFrame) -> DataFrame:
    """Hottest sensor in -40..150 and reading per sensor; non-positive readings are ignored."""
    rows = _rows(varbinds, "temp").where(_starts(TEMP_OIDS))
    per = rows.groupBy("device_id", "ts", F.concat(F.lit("sensor_"), _last_part()).alias("sensor")).agg(F.max("_num").alias("v"))
    hot = F.greatest(F.lit(-40.0), F.least(F.lit(150.0), rnd(F.greatest(F.max("v"), F.lit(0.0)), 2)))
    sensors = F.map_from_entries(F.array_sort(F.array_compact(F.collect_list(F.when(F.col("v") > 0, F.struct("sensor", "v"))))))
    return per.groupBy("device_id", "ts").agg(hot.alias("temp_c"), sensors.alias("temp_metrics"))


def _storage_pick(rows: Column) -> Column:
    """RAM and largest disk (total and used bytes, NULL where there is none) of one walk's storage rows (i, p, value).

    Entries are read in index order. A named RAM entry always counts, the last one stays; an unnamed one of RAM size
    only while no RAM has been found. Of the rest the largest wins, but one that is named a disk replaces what was before.
    """

    def field(i: Column, p: str) -> Column:
        return F.array_max(F.transform(F.filter(rows, lambda r: (r["i"] == i) & (r["p"] == p)), lambda r: r["value"]))

    def number(i: Column, p: str) -> Column:
        # a plain cast would fail on words under ANSI rules
        return F.coalesce(F.array_max(F.transform(F.filter(rows, lambda r: (r["i"] == i) & (r["p"] == p)), lambda r: r["num"])), F.lit(0.0))

    ids = F.array_sort(F.array_distinct(F.transform(rows, lambda r: F.struct(r["idx"].alias("idx"), r["i"].alias("i")))))
    entries = F.transform(ids, lambda e: F.struct(
        F.lower(F.coalesce(field(e["i"], "2"), F.lit(""))).alias("kind"), number(e["i"], "4").alias("au"), number(e["i"], "5").alias("size"), number(e["i"], "6").alias("used"),
    ))
    pair = "cast(NULL AS struct<total:double,use:double>)"
    start = F.struct(F.expr(pair).alias("r"), F.expr(pair).alias("d"))

    def read(acc: Column, e: Column) -> Column:
        own = F.struct((e["size"] * e["au"]).alias("total"), (e["used"] * e["au"]).alias("use"))
        real, total = (e["size"] > 0) & (e["au"] > 0), e["size"] * e["au"]
        ram = real & (e["kind"].rlike(RAM_TYPES) | (acc["r"].isNull() & (total > RAM_MIN) & (total < RAM_MAX)))
        disk = real & ~ram & (e["kind"].rlike(DISK_TYPES) | acc["d"].isNull() | (total >= acc["d"]["total"]))
        return F.struct(F.when(ram, own).otherwise(acc["r"]).alias("r"), F.when(disk, own).otherwise(acc["d"]).alias("d"))

    return F.aggregate(entries, start, read)


def _storage_rows(varbinds: DataFrame) -> DataFrame:
    """The storage rows of a walk table with `_st`, the row as an entry of `_storage_pick`; NULL for other rows."""
    parts = F.split("oid", r"\.")
    i = F.element_at(parts, -1)
    own = (F.col("walker") == "storage") & F.col("oid").startswith(STORAGE_OID)
    return varbinds.withColumn("_st", F.when(own, F.struct(F.expr("try_cast(element_at(split(oid, '[.]'), -1) as long)").alias("idx"), i.alias("i"), F.element_at(parts, -2).alias("p"), F.col("value").alias("value"), F.col("_num").alias("num"))))


def _sized(c: Column, unit: float, name: tuple[str, str, str]) -> list[Column]:
    """Total, used and free of a pair in bytes; a total that is missing or zero is 1, totals are capped, used never above."""
    total = F.coalesce(F.nullif(c["total"] / unit, F.lit(0.0)), F.lit(1.0))
    used = F.least(F.coalesce(c["use"] / unit, F.lit(0.0)), total)
    total = F.least(total, F.lit(CAP))
    return [rnd(total, 2).alias(name[0]), rnd(F.least(used, total), 2).alias(name[1]), rnd(F.greatest(total - used, F.lit(0.0)), 2).alias(name[2])]


_RAM, _DISK = ("ram_total_mb", "ram_used_mb", "ram_free_mb"), ("disk_total_gb", "disk_used_gb", "disk_free_gb")


def storage_metrics(varbinds: DataFrame) -> DataFrame:
    """RAM and largest disk from the storage table; totals are capped and never below what is used."""
    rows = _storage_rows(_rows(varbinds, "storage")).where("_st IS NOT NULL")
    # one entry for each line of one walk's storage table
    picked = rows.groupBy("device_id", "ts").agg(_storage_pick(F.collect_list("_st")).alias("s"))
    return picked.select("device_id", "ts", *_sized(F.col("s")["r"], 1048576.0, _RAM), *_sized(F.col("s")["d"], 1073741824.0, _DISK))


def interface_counters(varbinds: DataFrame) -> DataFrame:
    """One row per device, poll and interface with its octet counters, errors, drops and status."""
    rows = _rows(varbinds, "net")

    def part(table: str, i: int) -> Column:
        return F.regexp_extract("oid", table, i)

    tagged = rows.withColumns({"_ip": part(IF_TABLE, 1), "_ii": part(IF_TABLE, 2), "_xp": part(IFX_TABLE, 1), "_xi": part(IFX_TABLE, 2)})
    tagged = tagged.withColumn("iface", F.when(F.col("_ii") != "", F.col("_ii")).otherwise(F.col("_xi"))).where(F.col("iface") != "")
    count = F.coalesce(F.expr("try_cast(value as decimal(20,0))"), F.lit(0).cast("decimal(20,0)"))

    def of(table: str, p: str, v: Column) -> Column:
        return F.when(F.col(table) == p, v)

    zero = F.lit(0).cast("decimal(20,0)")
    return tagged.groupBy("device_id", "ts", "iface").agg(
        F.coalesce(F.max(of("_ip", "2", F.col("value"))), F.lit("")).alias("name"),
        F.coalesce(F.max(of("_ip", "8", F.expr("try_cast(value as int)"))), F.lit(1)).alias("status"),
        *[F.coalesce(F.max(of(t, p, count)), zero).alias(n) for n, t, p in (("rx32", "_ip", "10"), ("tx32", "_ip", "16"), ("rx64", "_xp", "6"), ("tx64", "_xp", "10"))],
        F.coalesce(F.sum(of("_ip", "13", count)), F.lit(0)).cast("long").alias("drops"),
        F.coalesce(F.sum(of("_ip", "14", count)), F.lit(0)).cast("long").alias("errors"),
    )


def machine_metrics(varbinds: DataFrame) -> DataFrame:
    """Scaled machine readings; the two position-error sensors are averaged."""
    scale = F.create_map(*[x for oid, (_, d) in MACHINE_OIDS.items() for x in (F.lit(oid), F.lit(float(d)))])
    name = F.create_map(*[x for oid, (n, _) in MACHINE_OIDS.items() for x in (F.lit(oid), F.lit(n))])
    rows = _rows(varbinds, "ldi").where(F.col("oid").isin(list(MACHINE_OIDS)))
    rows = rows.withColumns({"_m": name[F.col("oid")], "_v": F.col("_num") / scale[F.col("oid")]})
    names = dict.fromkeys(n for n, _ in MACHINE_OIDS.values())
    aggs = [
        (F.avg(F.when(F.col("_m") == n, F.col("_v"))) if n == "pe" else rnd(F.max(F.when(F.col("_m") == n, F.col("_v"))), 2)).alias(n)
        for n in names
    ]
    return rows.groupBy("device_id", "ts").agg(*aggs)


def position_error(varbinds: DataFrame) -> DataFrame:
    """(device_id, ts, pe): the half average over the single readings of both sensors, after the last one of each poll."""
    pe = {oid: float(d) for oid, (n, d) in MACHINE_OIDS.items() if n == "pe"}
    scale = F.create_map(*[x for oid, d in pe.items() for x in (F.lit(oid), F.lit(d))])
    rows = _rows(varbinds, "ldi").where(F.col("oid").isin(list(pe))).withColumn("_v", F.col("_num") / scale[F.col("oid")])
    levels = half_average(rows.select("device_id", "ts", "oid", "_v"), ["device_id"], ["ts", "oid"], "_v", "_z")
    return levels.groupBy("device_id", "ts").agg(F.max_by("_z", "oid").alias("pe"))


_PE = {oid: float(d) for oid, (n, d) in MACHINE_OIDS.items() if n == "pe"}
_LAST = ("cpu", "ram", "ram_use", "disk", "disk_use", "stored")


def whole_walks(varbinds: DataFrame) -> DataFrame:
    """(device_id, ts, walker, items): each walk as one row, as a collector hands it over."""
    return varbinds.groupBy("device_id", "ts", "walker").agg(F.collect_list(F.struct("oid", "value")).alias("items"))


def walk_readings(walks: DataFrame) -> DataFrame:
    """What each row of `whole_walks` says of its device, NULL where it says nothing.

    cpu: mean load; temp: hottest sensor above zero; ram, disk: total and used bytes; stored: 1 for a storage walk;
    pe_1, pe_2: the position-error sensors. A row is worked out by itself, so streams take it as batches do.
    """

    def read(r: Column) -> Column:
        oid = F.regexp_replace(r["oid"], ",", ".")
        tail = F.reverse(F.split(oid, r"\."))
        number = F.coalesce(r["value"].try_cast("double"), F.lit(0.0))
        return F.struct(oid.alias("oid"), r["value"].alias("value"), number.alias("num"), F.get(tail, 0).try_cast("long").alias("idx"), F.get(tail, 0).alias("i"), F.get(tail, 1).alias("p"))

    rows = walks.withColumn("_r", F.transform(F.filter("items", lambda r: r["oid"].isNotNull()), read))

    def numbers(walker: str, own: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter("_r", lambda r: (F.col("walker") == walker) & own(r)), lambda r: r["num"])

    core = numbers("cpu", lambda r: F.exists(F.array(*map(F.lit, CPU_OIDS)), lambda p: F.startswith(r["oid"], p)))
    load = F.when(F.size(core) > 0, rnd(F.aggregate(core, F.lit(0.0), lambda a, v: a + v) / F.size(core), 2))
    hot = F.array_max(numbers("temp", lambda r: (r["num"] > 0) & F.exists(F.array(*map(F.lit, TEMP_OIDS)), lambda p: F.startswith(r["oid"], p))))

    def sensor(oid: str) -> Column:
        return F.array_max(numbers("ldi", lambda r: r["oid"] == oid)) / _PE[oid]

    pe = [sensor(oid).alias(f"pe_{i}") for i, oid in enumerate(_PE, 1)]
    stored = F.filter("_r", lambda r: (F.col("walker") == "storage") & F.startswith(r["oid"], F.lit(STORAGE_OID)))
    told = rows.select("device_id", "ts", "walker", load.alias("cpu"), hot.alias("temp"), _storage_pick(stored).alias("s"), *pe)
    store = [F.col("s")[p][f].alias(n) for p, f, n in (("r", "total", "ram"), ("r", "use", "ram_use"), ("d", "total", "disk"), ("d", "use", "disk_use"))]
    return told.select("device_id", "ts", "walker", "cpu", "temp", *store, F.when(F.col("walker") == "storage", 1.0).alias("stored"), "pe_1", "pe_2")


def walk_machine() -> Machine:
    """The state of a device over its walks: last known load, RAM and disk, hottest temperature so far, half average."""
    return Together(LastKnown(_LAST, ("temp",)), HalfAverage(("pe_1", "pe_2"), "pe_now"))


WALK_STATE = {**{f"{c}_now": "double" for c in (*_LAST, "temp")}, "pe_now": "double"}


def shown_state(walks: DataFrame) -> DataFrame:
    """The columns that a row of the device shows, from the outputs of `walk_machine`."""

    def known(c: str) -> Column:
        return F.nanvl(F.col(f"{c}_now"), F.lit(None).cast("double"))

    def pair(c: str, unit: float, names: tuple[str, str, str]) -> list[Column]:
        sized = _sized(F.struct(known(c).alias("total"), known(f"{c}_use").alias("use")), unit, names)
        # before the first storage walk there is nothing to show
        return [F.when(known("stored").isNull(), 0.0).otherwise(v).alias(n) for v, n in zip(sized, names)]

    return walks.select(
        "device_id", "ts", "walker", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(known("cpu"), F.lit(0.0)))).alias("cpu_load_percent"),
        F.greatest(F.lit(-40.0), F.least(F.lit(150.0), rnd(F.coalesce(known("temp"), F.lit(0.0)), 2))).alias("temp_c"),
        *pair("ram", 1048576.0, _RAM), *pair("disk", 1073741824.0, _DISK), F.coalesce(known("pe"), F.lit(0.0)).alias("pe"),
    )


def device_state(varbinds: DataFrame, max_rows: int | None = None) -> DataFrame:
    """The state of each device after each of its walks: what a walk does not tell stays as earlier walks left it.

    The temperature is the hottest ever seen; load, RAM and disk are the last ones known, a storage walk without RAM or
    disk keeps the pair before it; the position error is half averaged over every reading. Zero stands for what no walk
    has told yet.
    """
    return shown_state(in_chunks(walk_readings(whole_walks(varbinds)), ["device_id"], ["ts", "walker"], walk_machine(), WALK_STATE, max_rows))


def normalize_varbinds(varbinds: DataFrame) -> dict[str, DataFrame]:
    """All metric tables of a walk table."""
    return {
        "cpu": cpu_metrics(varbinds), "temp": temp_metrics(varbinds), "storage": storage_metrics(varbinds),
        "net": interface_counters(varbinds), "ldi": machine_metrics(varbinds),
    }
