"""Text labels: bands, severities, owners, key clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def capability_class(cpk: Column) -> Column:
    return (
        F.when(cpk.isNull(), F.lit(None).cast("string"))
        .when(cpk >= 2.0, "World Class")
        .when(cpk >= 1.67, "Excellent")
        .when(cpk >= 1.33, "Capable")
        .when(cpk >= 1.0, "Marginally Capable")
        .otherwise("Not Capable")
    )


def freshness(seconds: Column) -> Column:
    return F.when(seconds <= 30, "online").when(seconds <= 300, "stale").otherwise("offline")


def confidence_label(cpk: Column, n: Column, min_n: int = 30) -> Column:
    low = f"LOW SAMPLE (n<{min_n})"
    return F.when(cpk.isNull(), "NO_DATA").when(F.coalesce(n, F.lit(0)) < min_n, low).otherwise("OK")


def elapsed_text(seconds: Column) -> Column:
    """'12m' below one hour, else '1h05m' (hours within the day, as the interval's hour field)."""
    whole = F.floor(F.greatest(seconds, F.lit(0)))
    minute = F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("int")
    hour = F.floor(F.pmod(whole, F.lit(86400)) / 3600).cast("int")
    short = F.concat(minute.cast("string"), F.lit("m"))
    long = F.concat(hour.cast("string"), F.lit("h"), F.lpad(minute.cast("string"), 2, "0"), F.lit("m"))
    return F.when(seconds < 3600, short).otherwise(long)


# Severity keywords, tried in this order on the alarm message.
CRITICAL_WORDS = (
    "emergency|e-stop|estop|crash|collision|overcurrent|fire|critical|safety|violation|overheat|speeding|"
    "hyper-?acceleration"
)
MINOR_WORDS = "timeout|retry|not supported|empty|invalid|parameter|please|not found"


def classify_severity(msg: Column, alarm_type: Column) -> Column:
    """Safety keyword, then type E or W, then procedural keyword, else Major."""
    kind = F.upper(F.trim(alarm_type))
    return (
        F.when(msg.rlike(f"(?i){CRITICAL_WORDS}"), "Critical")
        .when(kind == "E", "Critical")
        .when(kind == "W", "Warning")
        .when(msg.rlike(f"(?i){MINOR_WORDS}"), "Minor")
        .otherwise("Major")
    )


# Team that owns each alarm category, and the first action of each team.
CATEGORY_OWNER = {
    "VACUUM": "Maintenance",
    "CAMERA": "Maintenance",
    "MOTION": "Maintenance",
    "MOTOR": "Maintenance",
    "ENVIRONMENT": "Facility",
    "NETWORK": "Automation",
    "PLC": "Automation",
    "COMMUNICATION": "Automation",
    "DATABASE": "IT",
    "ALIGNMENT": "Process Engineering",
    "CALIBRATION": "Process Engineering",
    "REGISTRATION": "Process Engineering",
    "PROCESS": "Process Engineering",
}
DEFAULT_OWNER = "Maintenance"
CATEGORY_ACTION = {
    "Maintenance": "CALL MAINT",
    "Facility": "CHECK HVAC",
    "Automation": "CHECK AUTOMATION",
    "IT": "CALL IT",
    "Process Engineering": "CHECK PROCESS",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def category_owner(category: Column) -> Column:
    return F.coalesce(_lookup(CATEGORY_OWNER, category), F.lit(DEFAULT_OWNER))


def owner_action(owner: Column) -> Column:
    return _lookup(CATEGORY_ACTION, owner)


def quality_impact() -> Column:
    """First violated spec by priority, from the flag columns of the alarm context."""
    return (
        F.when(F.col("flag_pe_out_of_spec"), "PE/JE Out of Spec")
        .when(F.col("flag_thermal_out_of_spec"), "Thermal Out of Spec")
        .when(F.col("flag_humidity_out_of_spec"), "Humidity Out of Spec")
        .when(F.col("flag_vac_out_of_spec"), "Vacuum Out of Spec")
        .when(F.col("flag_scan_speed_out_of_spec"), "Scan Speed Out of Spec")
        .when(F.col("flag_exposure_out_of_spec"), "Exposure Out of Spec")
        .otherwise("Within Spec")
    )


def normalize_oid(c: Column | str) -> Column:
    """Dotted OID from an array of numbers or from comma-separated text; pass an array column as array<string>."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, ",", ".")


def normalize_oid_array(c: Column | str) -> Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, ".")


def safe_key(c: Column | str) -> Column:
    """Keep letters, digits, underscore and dash; anything else becomes an underscore."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9_-]", "_")
