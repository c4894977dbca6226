"""Declared schemas (Spark DDL) and the column groups the operators work on."""

PE_COLS = [f"pe_{i}" for i in range(1, 7)]
JE_COLS = [f"je_{i}" for i in range(1, 5)]

DEVICES = (
    "device_id STRING, hostname STRING, location STRING, device_type STRING, enabled BOOLEAN, process_type STRING"
)

TELEMETRY = (
    "time TIMESTAMP, factory STRING, process STRING, eqp_id STRING, mo STRING, fpn STRING, layer_name STRING, "
    "resist_dosage DOUBLE, scale_x DOUBLE, scale_y DOUBLE, temperature DOUBLE, humidity DOUBLE, scan_speed FLOAT, "
    "air_vacuum FLOAT, thickness DOUBLE, board_no SMALLINT, total_board SMALLINT, total_time FLOAT, filmno STRING, "
    "board_id STRING, resist STRING, state BOOLEAN, scale_mode STRING, "
    + ", ".join(f"{c} DOUBLE" for c in PE_COLS + JE_COLS)
    + ", pe_setting FLOAT, je_setting FLOAT, log_id STRING, ingest_ts TIMESTAMP"
)

ALARMS = (
    "logid STRING, logdate TIMESTAMP, errorcode STRING, errortime STRING, equipmentid STRING, factory STRING, "
    "process STRING, related_log_id STRING, link_basis STRING, ingest_ts TIMESTAMP"
)

CATALOG = (
    "alarm_id STRING, alarm_type STRING, alarm_code STRING, alarm_msg STRING, alarm_detail STRING, severity STRING, "
    "cause STRING, impact STRING, recovery_action STRING, sop_reference STRING"
)

LIFECYCLE = (
    "logid STRING, logdate TIMESTAMP, status STRING, acknowledged_at TIMESTAMP, acknowledged_by STRING, "
    "resolved_at TIMESTAMP, resolved_by STRING, resolution_note STRING, updated_at TIMESTAMP"
)

ACTIONS = "logid STRING, logdate TIMESTAMP, action STRING, actor STRING, note STRING, action_ts TIMESTAMP"

SYS_METRICS = (
    "time TIMESTAMP, device_id STRING, cpu_cores INT, cpu_load_percent DOUBLE, ram_total_mb DOUBLE, ram_used_mb DOUBLE, "
    "ram_free_mb DOUBLE, disk_total_gb DOUBLE, disk_used_gb DOUBLE, disk_free_gb DOUBLE, disk_description STRING, "
    "temp_c DOUBLE, cpu_metrics MAP<STRING,DOUBLE>, temp_metrics MAP<STRING,DOUBLE>, ingest_ts TIMESTAMP"
)

NET_METRICS = (
    "time TIMESTAMP, device_id STRING, iface_name STRING, rx_mbps DOUBLE, tx_mbps DOUBLE, rx_errors BIGINT, "
    "tx_errors BIGINT, rx_drops BIGINT, tx_drops BIGINT, status STRING"
)

VARBINDS = "device_id STRING, ts TIMESTAMP, walker STRING, oid STRING, value STRING"

COUNTERS = (
    "device_id STRING, iface STRING, name STRING, ts TIMESTAMP, rx64 DECIMAL(20,0), tx64 DECIMAL(20,0), "
    "rx32 DECIMAL(20,0), tx32 DECIMAL(20,0), status INT"
)

# Raw JSON telemetry arrives untyped; every field is read as text and coerced afterwards.
TELEMETRY_TEXT = [
    "eqp_id", "factory", "process", "mo", "fpn", "layer_name", "filmno", "board_id", "scale_mode", "log_id",
]
TELEMETRY_NUMBER = [
    "resist_dosage", "scale_x", "scale_y", "temperature", "humidity", "scan_speed", "air_vacuum", "thickness",
    "total_time", *PE_COLS, *JE_COLS, "pe_setting", "je_setting",
]
TELEMETRY_INTEGER = ["board_no", "total_board"]
