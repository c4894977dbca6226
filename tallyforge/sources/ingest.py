"""Ingestion: JSON telemetry, alarm logs, container events, idempotent appends, catalog upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import latest_per_key
from ..schema import TELEMETRY_INTEGER, TELEMETRY_NUMBER, TELEMETRY_TEXT

# every field is declared as text and coerced afterwards: one malformed value must not lose its row
RAW_TELEMETRY = T.StructType(
    [T.StructField(c, T.StringType()) for c in [*TELEMETRY_TEXT, *TELEMETRY_NUMBER, *TELEMETRY_INTEGER, "resist", "state", "time"]]
)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


# Fixed value: text that counts as a number.
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _number(c: str) -> Column:
    return F.when(F.col(c).rlike(_NUMBER), F.trim(F.col(c)).try_cast("double"))


def _integer(c: str) -> Column:
    # leading digits count, as in '12 of 40'
    return F.expr(f"try_cast(regexp_extract(`{c}`, '^\\\\s*([+-]?[0-9]+)', 1) as int)")


def ingest_telemetry(raw: DataFrame, json_col: str = "value") -> DataFrame:
    """Typed telemetry rows from JSON text: one object or an array of objects per input row.

    Rows without a machine id are dropped, numbers that do not parse become NULL, missing text becomes '', and state
    is true unless the field is the boolean false. Works on batch and streaming input.
    """
    body = F.trim(F.col(json_col))
    as_array = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    texts = raw.select(F.explode(F.from_json(as_array, T.ArrayType(T.StringType()))).alias("j"))
    off = F.expr("coalesce(try_variant_get(try_parse_json(j), '$.state', 'string') = 'false' AND schema_of_variant(try_variant_get(try_parse_json(j), '$.state', 'variant')) = 'BOOLEAN', false)")
    items = texts.select(F.from_json("j", RAW_TELEMETRY).alias("o"), off.alias("off")).select("o.*", "off")
    kept = items.where(_text("eqp_id") != "")
    return kept.select(
        F.expr("try_cast(time as timestamp)").alias("time"),
        *[_text(c).alias(c) for c in TELEMETRY_TEXT],
        *[_number(c).alias(c) for c in TELEMETRY_NUMBER],
        *[_integer(c).alias(c) for c in TELEMETRY_INTEGER],
        F.nullif(F.col("resist"), F.lit("")).alias("resist"),
        (~F.col("off")).alias("state"),
    )


# Container actions worth keeping.
CONTAINER_ACTIONS = ["start", "die", "restart", "kill", "oom"]
_CONTAINER = "Action STRING, time DOUBLE, Actor STRUCT<Attributes: STRUCT<name: STRING>>"


def ingest_container_events(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Container lifecycle events from JSON lines; the raw line is kept."""
    e = lines.select(F.from_json(F.col(text_col), _CONTAINER).alias("e"), F.col(text_col).alias("raw_event"))
    out = e.select(
        F.col("e.Actor.Attributes.name").alias("container_name"), F.col("e.Action").alias("event_action"),
        F.timestamp_micros((F.col("e.time") * 1_000_000).cast("long")).alias("event_time"), "raw_event",
    )
    return out.where(F.col("event_action").isin(CONTAINER_ACTIONS) & (F.coalesce("container_name", F.lit("")) != "") & F.col("event_time").isNotNull())


def append_idempotent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose key is not stored yet, one per key."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """base with delta's rows replacing those of equal key, one row per key.

    Where delta repeats a key, the row with the largest `newest` counts, without that column any one of them.
    """
    one = latest_per_key(delta, keys, newest) if newest else delta.dropDuplicates(keys)
    kept = base.join(one.select(*keys), keys, "left_anti")
    return kept.unionByName(one.select(*base.columns))


def patch_column(df: DataFrame, key: str, column: str, mapping: dict[str, str]) -> DataFrame:
    """Overwrite one column for the listed keys; keys that match nothing change nothing. The mapping is code-sized."""
    pairs = df.sparkSession.createDataFrame(list(mapping.items()), f"`{key}` string, _new string")
    patched = df.join(F.broadcast(pairs), key, "left")
    return patched.select(*[F.coalesce("_new", column).alias(column) if c == column else c for c in df.columns])


def normalize_sentinels(df: DataFrame, zero_null: list[str], blank_null: list[str]) -> DataFrame:
    """0 means not measured in `zero_null` columns; '' means missing in `blank_null` columns."""
    return df.withColumns(
        {c: F.nullif(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in zero_null}
        | {c: F.nullif(F.col(c), F.lit("")) for c in blank_null}
    )


def backfill_metric_maps(df: DataFrame) -> DataFrame:
    """Fill empty per-core and per-sensor maps from the scalar readings."""
    def empty(c: str) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) <= 0

    cpu = F.create_map(F.lit("avg"), F.col("cpu_load_percent"))
    temp = F.create_map(F.lit("sensor_1"), F.col("temp_c"))
    return df.withColumns(
        {
            "cpu_metrics": F.when(empty("cpu_metrics") & F.col("cpu_load_percent").isNotNull(), cpu).otherwise(F.col("cpu_metrics")),
            "temp_metrics": F.when(empty("temp_metrics") & (F.col("temp_c") > 0), temp).otherwise(F.col("temp_metrics")),
        }
    )


def stamp_ingest(df: DataFrame) -> DataFrame:
    """Commit time of the write."""
    return df.withColumn("ingest_ts", F.current_timestamp())
