"""State per key on streams with many keys: a call of Python takes a bucket of keys, each with its own rows and state.

A call, its pandas frames and its state row cost about as much as a thousand plain rows, so a call for each key makes the
time of a stream follow the number of its keys. Keys are dealt to `BUCKETS` buckets by hash; a bucket's state holds the
states of its keys, and a key is called when it has rows or its timer is over, as if it were a group of its own.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKETS = 4096
_NO_TIME = np.iinfo(np.int64).min

# (key, new rows in the order they came, state or None, watermark in ms) -> (state or None, rows to emit, timer in ms or None)
Each = Callable[[tuple, list[tuple], Any, int], tuple[Any, list[tuple], int | None]]


def _values(column: pd.Series, type_: str) -> list:
    """Plain values of a column: times in microseconds, None for what is missing."""
    if type_ == "timestamp":
        us = column.astype("datetime64[us]").astype("int64")
        return [None if v == _NO_TIME else v for v in us.tolist()]
    values = column.astype(object).where(column.notna(), None).tolist()
    return [None if v is None else int(v) for v in values] if type_ in ("tinyint", "smallint", "int", "bigint") else values


def _column(values: tuple, type_: str) -> pd.Series:
    if type_ == "timestamp":
        return pd.Series(np.array([_NO_TIME if v is None else v for v in values], np.int64).view("datetime64[us]"))
    return pd.Series(np.array(values, np.float64)) if type_ == "double" else pd.Series(list(values), dtype=object)


def each_key(df: DataFrame, keys: list[str], names: list[str], each: Each, out: dict[str, str], timed: bool, buckets: int = BUCKETS) -> DataFrame:
    """Run `each` over the keys of a stream; rows arrive as tuples of `names` and are emitted as tuples of `out`.

    A state of None is forgotten. A key without new rows is called once the watermark has passed its timer.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    # keys with nulls have buckets of their own, and whole numbers travel as strings: pandas would make them floats
    missing = sum((F.col(f"`{k}`").isNull().cast("int") * (1 << i) for i, k in enumerate(keys)), F.lit(0))
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)) + missing * buckets
    read = list(dict.fromkeys([*keys, *names]))
    rows = df.select(bucket.alias("_bucket"), *[(F.col(f"`{n}`").cast("string") if types[n] == "bigint" else F.col(f"`{n}`")).alias(n) for n in read])

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known: dict[tuple, tuple] = pickle.loads(state.get[0]) if state.exists else {}
        came: dict[tuple, list[tuple]] = {}
        if not state.hasTimedOut:
            for pdf in batches:
                columns = {n: _values(pdf[n], types[n]) for n in read}
                for key, row in zip(zip(*[columns[k] for k in keys]), zip(*[columns[n] for n in names])):
                    came.setdefault(key, []).append(row)
        now = state.getCurrentWatermarkMs() if timed else 0
        due = [k for k, (_, timer) in known.items() if timer is not None and timer < now and k not in came] if timed else []
        made: list[tuple] = []
        for key, own in [*came.items(), *((k, []) for k in due)]:
            inner, emitted, timer = each(key, own, known.get(key, (None, None))[0], now)
            if inner is None:
                known.pop(key, None)
            else:
                known[key] = inner, timer
            made.extend((*key, *r) for r in emitted)
        if known:
            state.update((pickle.dumps(known, pickle.HIGHEST_PROTOCOL),))
            timers = [timer for _, timer in known.values() if timer is not None]
            if timed and timers:
                state.setTimeoutTimestamp(min(timers))
        elif state.exists:
            state.remove()
        if made:
            shown = {**{k: types[k] for k in keys}, **out}
            yield pd.DataFrame({n: _column(c, t) for (n, t), c in zip(shown.items(), zip(*made))})

    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], *[f"`{n}` {t}" for n, t in out.items()]])
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return rows.groupBy("_bucket").applyInPandasWithState(step, schema, "held binary", "append", timeout)


def last_nulls(row: tuple, at: tuple[int, ...]) -> tuple:
    """Sorting key of the columns `at`: nulls come last."""
    return tuple((row[i] is None, row[i]) for i in at)
