"""The benchmark tables seen as factory data.

`events` is read as machine telemetry (every type but 'error') and as the alarm log ('error'), and as a whole as
system, network and probe readings; `customer` is the device registry, `part` the alarm catalog, `orders` an alarm
lifecycle. Column expressions are written once, in SQL that Spark and the checking engine read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.alarms import with_severity

AS_OF = "2024-01-31 00:00:00"

# (name, source table, filter, columns); `us:` marks "timestamp column + microseconds"
_DEVICE = "'D' || CAST(user_id AS STRING)"

_TELE = [
    ("time", "ts"), ("factory", "CAST(1 + user_id % 3 AS STRING)"), ("process", "event_type"), ("eqp_id", _DEVICE),
    ("mo", "'MO' || CAST(k % 4 AS STRING)"), ("fpn", "'F' || CAST(k % 3 AS STRING)"),
    ("layer_name", "CASE WHEN k % 2 = 0 THEN 'inner' ELSE 'outer' END"), ("resist_dosage", "value * 4"),
    ("scale_x", "CAST(1 + k * 0.001 AS DOUBLE)"), ("scale_y", "CAST(1 - k * 0.001 AS DOUBLE)"), ("temperature", "19 + value / 25"),
    ("humidity", "CASE WHEN k = 13 THEN NULL ELSE CAST(48 + k * 0.13 AS DOUBLE) END"), ("scan_speed", "value * 4"),
    ("air_vacuum", "CASE WHEN event_type = 'view' THEN NULL ELSE CAST(-5 - k * 0.3 AS DOUBLE) END"), ("thickness", "1 + value / 1000"),
    ("board_no", "k % 25"), ("total_board", "25"), ("total_time", "value"), ("filmno", "'FM' || CAST(k AS STRING)"),
    ("board_id", "'B' || CAST(k AS STRING)"), ("resist", "CASE WHEN k % 2 = 0 THEN 'R1' ELSE 'R2' END"), ("state", "k % 3 <> 0"),
    ("scale_mode", "'auto'"),
    *[(f"pe_{i}", f"CASE WHEN k = 7 THEN NULL ELSE value / 10 - 5 + {i} * CAST(0.5 AS DOUBLE) END") for i in range(1, 6)],
    ("pe_6", "CASE WHEN k = 7 OR event_type = 'click' THEN NULL ELSE 3 - value / 10 END"),
    *[(f"je_{i}", f"CASE WHEN event_type = 'signup' THEN NULL ELSE CAST((k - 50) * 0.2 AS DOUBLE) + {i} * CAST(0.3 AS DOUBLE) END") for i in range(1, 5)],
    ("pe_setting", "CASE WHEN k % 10 = 0 THEN CAST(1 AS DOUBLE) WHEN k % 17 = 0 THEN NULL ELSE CAST(12 AS DOUBLE) END"),
    ("je_setting", "CAST(8 AS DOUBLE)"), ("log_id", "'T' || CAST(event_id AS STRING)"), ("ingest_ts", "us:ts:k * 7000 + 5000"),
]
_CODES = ["91009", "90005", "90001", "91008", "70004", "90012", "93004", "10006", "90004", "90777"]
_ALARMS = [
    ("logid", "'A' || CAST(event_id AS STRING)"), ("logdate", "ts"),
    ("errorcode", "CASE k % 10 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END"),
    ("errortime", "'E' || CAST(event_id AS STRING)"), ("equipmentid", _DEVICE), ("factory", "CAST(1 + user_id % 2 AS STRING)"),
    ("process", "event_type"),
    ("related_log_id", "CASE WHEN k % 4 = 0 THEN 'T' || CAST(event_id - 1 AS STRING) WHEN k % 4 = 1 THEN 'T' || CAST(event_id + 1 AS STRING) ELSE NULL END"),
    ("link_basis", "CASE WHEN k % 2 = 0 THEN 'causal' ELSE 'nearest' END"), ("ingest_ts", "us:ts:(k - 5) * 3000"),
]
_VIEWS: dict[str, tuple[str, str | None, list[tuple[str, str]]]] = {
    "tele": ("ev", "event_type <> 'error'", _TELE),
    "alarms": ("ev", "event_type = 'error'", _ALARMS),
    "sysm": (
        "ev", None,
        [
            ("time", "ts"), ("device_id", _DEVICE), ("cpu_load_percent", "CASE WHEN value > 100 THEN CAST(100 AS DOUBLE) ELSE value END"),
            ("ram_total_mb", "CAST(16384 AS DOUBLE)"), ("ram_used_mb", "CAST(k * 165 AS DOUBLE)"), ("disk_total_gb", "CAST(500 AS DOUBLE)"),
            ("disk_used_gb", "CAST(300 + event_id % 97 AS DOUBLE) + k"), ("temp_c", "CAST(20 + k * 0.7 AS DOUBLE)"), ("event_id", "event_id"),
            ("ingest_ts", "us:ts:k * 11000"),
        ],
    ),
    "netm": (
        "ev", None,
        [
            ("time", "ts"), ("device_id", _DEVICE), ("iface_name", "'eth' || CAST(k % 2 AS STRING)"), ("rx_mbps", "value * 16"), ("tx_mbps", "CAST(k AS DOUBLE)"),
            ("rx_errors", "CAST(k AS BIGINT)"), ("rx_drops", "CAST(k % 60 AS BIGINT)"),
            ("status", "CASE WHEN event_type = 'purchase' OR k < 40 THEN 'DOWN' ELSE 'UP' END"), ("event_id", "event_id"),
        ],
    ),
    "machm": (
        "ev", None,
        [
            ("time", "ts"), ("device_id", _DEVICE), ("throughput", "value"), ("temperature", "CAST(20 + k * 0.1 AS DOUBLE)"),
            ("humidity", "CAST(40 + k * 0.2 AS DOUBLE)"), ("power_watt", "value * 20"), ("vibration", "CAST(k * 0.15 AS DOUBLE)"),
        ],
    ),
    "probes": (
        "ev", None,
        [
            ("time", "ts"), ("instance", "'P' || CAST(user_id AS STRING)"), ("success", "CASE WHEN event_type = 'error' THEN 0 ELSE 1 END"),
            ("duration_s", "value / 20"), ("cert_expiry", "us:ts:k * 86400000000"), ("probe_id", "event_id"),
        ],
    ),
    "counters": (
        "ev", None,
        [
            ("device_id", _DEVICE), ("iface", "CAST(k % 2 AS STRING)"), ("name", "CASE WHEN k % 2 = 0 THEN 'ge-0' ELSE CASE WHEN user_id % 5 = 0 THEN '' ELSE 'ge-1' END END"),
            ("ts", "ts"), ("rx64", "CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE event_id * 40000000000 END AS DECIMAL(20,0))"),
            ("tx64", "CAST(0 AS DECIMAL(20,0))"), ("rx32", "CAST(event_id * 1000 AS DECIMAL(20,0))"),
            ("tx32", "CAST(event_id * 30000 + k AS DECIMAL(20,0))"), ("status", "CASE WHEN event_type = 'view' THEN 2 ELSE 1 END"),
        ],
    ),
    "cycles": (
        "ev", None,
        [
            ("device_id", _DEVICE), ("ts", "ts"), ("walker", "CASE k % 5 WHEN 0 THEN 'cpu' WHEN 1 THEN 'storage' WHEN 2 THEN 'temp' WHEN 3 THEN 'net' ELSE 'ldi' END"),
            ("cpu", "CASE WHEN k % 5 = 0 THEN value ELSE NULL END"), ("temp", "CASE WHEN k % 5 = 2 THEN value ELSE NULL END"), ("event_id", "event_id"),
        ],
    ),
    "lifecycle": (
        "ev", "event_type = 'error'",
        [
            ("logid", "'A' || CAST(event_id AS STRING)"), ("logdate", "ts"),
            ("status", "CASE k % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END"),
            ("acknowledged_at", "us:ts:CASE WHEN k % 3 >= 1 THEN k * CAST(60000000 AS BIGINT) ELSE NULL END"),
            ("resolved_at", "us:ts:CASE WHEN k % 3 = 2 THEN k * CAST(180000000 AS BIGINT) ELSE NULL END"),
        ],
    ),
    "legacy": (
        "ev", None,
        [
            ("time", "ts"), ("machine_id", _DEVICE), ("throughput", "value"), ("uptime", "CAST(CASE WHEN k < 5 THEN 0 ELSE k * 900 END AS DOUBLE)"),
            ("pe", "CAST(k * 0.1 AS DOUBLE)"), ("je", "CAST(CASE WHEN k < 20 THEN 0 ELSE k * 0.05 END AS DOUBLE)"), ("row_id", "event_id"),
        ],
    ),
    "devices": (
        "customer", None,
        [
            ("device_id", "'D' || CAST(c_custkey AS STRING)"), ("hostname", "c_name"), ("location", "'N' || CAST(c_nationkey AS STRING)"),
            ("device_type", "CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE') THEN 'ldi' ELSE 'server' END"), ("enabled", "c_acctbal > 500"),
        ],
    ),
    "rawcat": (
        "part", None,
        [
            ("alarm_id", "CAST(p_partkey + 90000 AS STRING)"), ("alarm_type", "CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'E' WHEN 2 THEN 'W' ELSE ' w ' END"),
            ("alarm_code", "CAST(p_partkey + 90000 AS STRING)"),
            ("alarm_msg", "p_name || CASE p_size % 7 WHEN 0 THEN ' Emergency stop' WHEN 1 THEN ' Timeout' WHEN 2 THEN ' not found' WHEN 3 THEN ' dummy' ELSE '' END"),
            ("alarm_detail", "CASE WHEN p_size % 5 = 0 THEN 'NULL' ELSE p_type END"), ("cause", "p_brand"), ("impact", "p_type"), ("recovery_action", "p_name"),
            ("sop_reference", "CASE WHEN p_size % 2 = 0 THEN p_brand ELSE NULL END"),
        ],
    ),
    "orders_lifecycle": (
        "orders", None,
        [
            ("logid", "'O' || CAST(o_orderkey AS STRING)"), ("logdate", "o_orderdate"),
            ("status", "CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END"),
            ("acknowledged_at", "us:o_orderdate:CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 500 * 60000000 END"),
            ("resolved_at", "us:o_orderdate:CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) % 900 * 60000000 ELSE NULL END"),
        ],
    ),
}

CRITICAL_RE = "emergency|e-stop|estop|crash|collision|overcurrent|fire|critical|safety|violation|overheat|speeding|hyper-?acceleration"
MINOR_RE = "timeout|retry|not supported|empty|invalid|parameter|please|not found"

_EV_SQL = "SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events"
_CATALOG_SQL = (
    "SELECT * REPLACE (NULLIF(alarm_detail, 'NULL') AS alarm_detail), CASE "
    f"WHEN regexp_matches(alarm_msg, '{CRITICAL_RE}', 'i') THEN 'Critical' WHEN upper(trim(alarm_type)) = 'E' THEN 'Critical' "
    f"WHEN upper(trim(alarm_type)) = 'W' THEN 'Warning' WHEN regexp_matches(alarm_msg, '{MINOR_RE}', 'i') THEN 'Minor' ELSE 'Major' END AS severity FROM rawcat_"
)
CATEGORY_SQL = (
    "CASE WHEN {c} = '91009' THEN 'VACUUM' WHEN {c} = '90005' THEN 'REGISTRATION' WHEN {c} IN ('90001','90004','90012') THEN 'ALIGNMENT' "
    "WHEN {c} = '93004' THEN 'CALIBRATION' WHEN {c} = '91008' THEN 'ENVIRONMENT' WHEN {c} = '70004' THEN 'MOTION' WHEN {c} = '10006' THEN 'OPTICS' "
    "WHEN {c} IN ('01180016','0C020014') THEN 'SAFETY' "
    "WHEN {c} IN ('0106000C','01060013','0106001C','01100001','01130002','80001','92013','97005') THEN 'COMMUNICATION' "
    "WHEN {c} IN ('01060009','010E0064') THEN 'CONFIGURATION' ELSE 'UNCLASSIFIED' END"
)


def _duck(expr: str) -> str:
    if expr.startswith("us:"):
        _, ts, us = expr.split(":", 2)
        return f"make_timestamp(epoch_us({ts}) + ({us}))"
    return expr


def _spark(expr: str) -> str:
    if expr.startswith("us:"):
        _, ts, us = expr.split(":", 2)
        return f"timestamp_micros(unix_micros({ts}) + ({us}))"
    return expr


def view_sql(name: str) -> str:
    """SELECT text of a view for the checking engine."""
    if name == "catalog":
        return _CATALOG_SQL.replace("rawcat_", f"({view_sql('rawcat')})")
    src, cond, cols = _VIEWS[name]
    frm = f"({_EV_SQL})" if src == "ev" else src
    where = f" WHERE {cond}" if cond else ""
    return "SELECT " + ", ".join(f"{_duck(e)} AS {n}" for n, e in cols) + f" FROM {frm}{where}"


class Tables:
    """Views of one data directory. Each access builds a lazy DataFrame; column pruning keeps the scans narrow."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        # timestamps in the files carry no zone and mean UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def glob(self, name: str) -> str:
        """Pattern that a file stream accepts whether the table is one file or a folder of files."""
        return f"{self.dir}/{name}.parque[t]"

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self._read(name)
        return self._raw[name]

    def schema(self, name: str) -> T.StructType:
        """Stored schema with zone-less timestamps read as UTC instants: no cast stands between a filter and the scan."""
        stored = self.spark.read.parquet(self.path(name)).schema
        return T.StructType([T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType, f.nullable) for f in stored.fields])

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema(name)).parquet(self.path(name))

    @staticmethod
    def shape(df: DataFrame, name: str) -> DataFrame:
        """Apply the column expressions of a view to rows of its source table (batch or streaming)."""
        src, cond, cols = _VIEWS[name]
        if src == "ev":
            df = df.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        if cond:
            df = df.where(cond)
        return df.selectExpr(*[f"{_spark(e)} AS {n}" for n, e in cols])

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name != "catalog" and name not in _VIEWS):
            raise AttributeError(name)
        if name == "catalog":
            df = with_severity(self.shape(self.raw("part"), "rawcat"))
        else:
            src = _VIEWS[name][0]
            df = self.shape(self.raw("events" if src == "ev" else src), name)
        setattr(self, name, df)
        return df
