"""Registry of queries and of the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Tables, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def naive_times(df: DataFrame) -> DataFrame:
    """UTC timestamps without zone, as the SQL side has them."""
    cast = {f.name: F.col(f"`{f.name}`").cast("timestamp_ntz") for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
    return df.withColumns(cast) if cast else df


def query(name: str, views: str = "", sql: str | None = None, same_as: str | None = None):
    """Register `fn(tables)` under `name`; `sql` may use the named views of `tables.py` as if they were tables."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: naive_times(fn(Tables(spark, sf_dir)))
        if same_as:
            ORACLES[name] = ORACLES[same_as]
        elif sql is not None:
            body = sql.strip()
            ctes = [f"{v} AS ({view_sql(v)})" for v in views.split()]
            if body.upper().startswith("WITH "):
                body = (", " if ctes else "WITH ") + body[5:]
            ORACLES[name] = (("WITH " + ", ".join(ctes) + " ") if ctes else "") + body
        return fn

    return add


def r(expr: str, digits: int) -> str:
    """SQL of the rounding used throughout: half away from zero on the decimal value."""
    return f"CAST(round(CAST(({expr}) AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def seconds(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 1000000.0)"
