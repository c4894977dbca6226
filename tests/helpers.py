from __future__ import annotations

from datetime import datetime, timedelta

from tallyforge import schema

T0 = datetime(2024, 3, 1, 8, 0, 0)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def frame(spark, ddl: str, rows: list[dict]):
    """Rows given as dicts; missing columns are NULL."""
    target = spark.createDataFrame([], ddl).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in target.fields) for r in rows], target)


def telemetry(spark, rows: list[dict]):
    base = {"factory": "1", "process": "p", "eqp_id": "M1", "mo": "mo", "fpn": "f", "layer_name": "l", "state": True, "pe_setting": 12.0, "je_setting": 8.0}
    return frame(spark, schema.TELEMETRY, [{**base, "log_id": f"L{i:05d}", "time": at(i), **r} for i, r in enumerate(rows)])


def alarms(spark, rows: list[dict]):
    base = {"equipmentid": "M1", "errorcode": "91008", "factory": "1", "process": "p"}
    return frame(spark, schema.ALARMS, [{**base, "logid": f"A{i:05d}", "logdate": at(i), **r} for i, r in enumerate(rows)])


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]
