"""State machines over ordered histories, spread over chunks of a history.

What a machine does to a row depends on everything before it, through a state of a few numbers. A history is cut into
chunks of consecutive rows (see `series`). Every full chunk is summed up by what it makes of any state that can enter
it; the states at the chunk edges follow from the summaries alone, one short row a chunk; then all chunks run at once,
each from its own entry state. A hot key takes as many tasks as it has chunks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import written
from .series import _CHUNK, _GROUP, _POS, lay_out

MACHINE_ROWS = 1_000_000
_STATE = "_state"

Rows = dict[str, np.ndarray]


class Machine:
    """Reads the rows of a key in order; `columns` names what it reads, times arriving in microseconds.

    `run` gives the values it adds to the rows and the state after them; None is the state before the first row.
    `summary` and `advance` are the same for a whole chunk at once: `advance(state, summary(rows))` is the state that
    `run(state, rows)` ends in.
    """

    columns: tuple[str, ...] = ()

    def run(self, state: Any, rows: Rows) -> tuple[dict[str, np.ndarray], Any]:
        raise NotImplementedError

    def summary(self, rows: Rows) -> Any:
        raise NotImplementedError

    def advance(self, state: Any, summary: Any) -> Any:
        raise NotImplementedError


def as_array(column: pa.Array) -> np.ndarray:
    """A column as numpy array; times as microseconds, missing numbers as NaN."""
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64())
    return column.to_numpy(zero_copy_only=False)


def _keys(batch: pa.RecordBatch, group: list[str]) -> list[tuple]:
    return list(zip(*[batch.column(g).to_pylist() for g in group]))


def stretches(keys: list[tuple]) -> list[tuple[int, int]]:
    """[first, end) of each run of equal keys."""
    at = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
    return list(zip(at, at[1:]))


def _whole_groups(batches: Iterator[pa.RecordBatch], group: list[str], columns: list[str]) -> Iterator[tuple[tuple, Rows]]:
    """Every group with all its rows, which may come in several batches."""
    key: tuple | None = None
    held: list[Rows] = []

    def joined() -> Rows:
        return {c: np.concatenate([h[c] for h in held]) for c in columns}

    for batch in batches:
        keys, arrays = _keys(batch, group), {c: as_array(batch.column(c)) for c in columns}
        for a, b in stretches(keys):
            part = {c: v[a:b] for c, v in arrays.items()}
            if keys[a] == key:
                held.append(part)
                continue
            if key is not None:
                yield key, joined()
            key, held = keys[a], [part]
    if key is not None:
        yield key, joined()


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def in_chunks(df: DataFrame, keys: list[str], order: list[str], machine: Machine, added: dict[str, str], max_rows: int | None = None) -> DataFrame:
    """The rows of `df` with the columns that `machine` adds to them (`added`: name to type), in the order of each key.

    (key, order) must be unique for a reproducible result. Rows without a key are one history. The rows are numbered and
    written once, with all their columns.
    """
    size = max_rows or MACHINE_ROWS
    rows = written(lay_out(df, keys, order, size).df.drop(_GROUP), "chunks")
    group = [*keys, _CHUNK]
    read = list(dict.fromkeys([*machine.columns, _POS]))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = lambda names: ", ".join(f"`{n}` {types[n]}" for n in names)
    narrow = rows.select(*dict.fromkeys([*group, *order, *read]))
    chunk_types = to_arrow_schema(rows.select(*group).schema).append(pa.field(_STATE, pa.binary()))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # only a full chunk has another one after it
        for key, part in _whole_groups(batches, group, read):
            if len(part[_POS]) == size:
                yield _table([(*key, pickle.dumps(machine.summary(part)))], chunk_types)

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, state = None, None
        for batch in batches:
            out = []
            for key, summary in zip(_keys(batch, group), batch.column(_STATE).to_pylist()):
                if key[:-1] != known:
                    known, state = key[:-1], None
                state = machine.advance(state, pickle.loads(summary))
                out.append((*key[:-1], key[-1] + 1, pickle.dumps(state)))
            yield _table(out, chunk_types)

    chunk_ddl = f"{ddl(group)}, {_STATE} binary"
    summaries = narrow.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(summed, chunk_ddl)
    entries = summaries.repartition(*keys).sortWithinPartitions(*group).mapInArrow(entered, chunk_ddl)
    # the entry state goes ahead of the rows of its chunk
    marked = rows.withColumn(_STATE, F.lit(None).cast("binary")).unionByName(entries, allowMissingColumns=True)
    marked = marked.repartition(*group).sortWithinPartitions(*group, F.col(_STATE).isNull(), *order)
    kept = [c for c in rows.columns if c not in (_CHUNK, _POS)]

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, state = None, None
        for batch in batches:
            own, marks = batch.column(_STATE).is_null(), batch.column(_STATE).to_pylist()
            keys_, plain = _keys(batch, group), batch.filter(own)
            arrays, done, parts = {c: as_array(plain.column(c)) for c in read}, 0, []
            for a, b in stretches(keys_):
                if keys_[a] != known:
                    known, state = keys_[a], None
                if marks[a] is not None:
                    state, a = pickle.loads(marks[a]), a + 1
                if a < b:
                    made, state = machine.run(state, {c: v[done : done + b - a] for c, v in arrays.items()})
                    parts.append(made)
                    done += b - a
            if parts:
                new = [pa.array(np.concatenate([p[c] for p in parts])) for c in added]
                yield pa.RecordBatch.from_arrays([*[plain.column(c) for c in kept], *new], [*kept, *added])

    return marked.mapInArrow(ran, ", ".join([ddl(kept), *[f"`{c}` {t}" for c, t in added.items()]]))


class Fold:
    """What is done with a key's rows in order.

    `rows(inner, batch, now)` gets released rows (tuples in the order of the columns, times in microseconds) and the
    watermark, and gives the new inner state and the rows to emit; `due(inner)` is when it wants to be called again
    though nothing comes, or None; an inner state of None is forgotten. Emitted times are microseconds too.
    """

    def rows(self, key: tuple, inner: Any, batch: list[tuple], now: int) -> tuple[Any, list[tuple]]:
        raise NotImplementedError

    def due(self, inner: Any) -> int | None:
        return None


def fold_keys(df: DataFrame, keys: list[str], ts: str, tie: list[str], cols: list[str], fold: Fold, out: dict[str, str], until: Any) -> DataFrame:
    """Run `fold` over each key's rows in order and then up to the time `until` (a timestamp), as a stream would.

    A key's rows pass through one task in order, one Arrow batch at a time, beside the state of one key.
    """
    names = list(dict.fromkeys([ts, *tie, *cols]))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    end = until if isinstance(until, int) else int(df.sparkSession.range(1).select(F.unix_micros(F.lit(until).cast("timestamp"))).first()[0])
    rows = df.where(F.col(ts).isNotNull() & (F.unix_micros(ts) <= end)).select(*dict.fromkeys([*keys, *names]))
    schema = [*[(k, types[k]) for k in keys], *out.items()]
    target = to_arrow_schema(df.sparkSession.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in schema)).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, inner = None, None

        def told(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*[(*known, *r) for r in rows]))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(f.type) if pa.types.is_timestamp(f.type) else pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

        def step(rows: list[tuple], now: int) -> list[tuple]:
            nonlocal inner
            inner, emitted = fold.rows(known, inner, rows, now)
            return emitted

        for batch in batches:
            owners, columns = _keys(batch, keys), [as_array(batch.column(n)).tolist() if pa.types.is_timestamp(batch.column(n).type) else batch.column(n).to_pylist() for n in names]
            for a, b in stretches(owners):
                if owners[a] != known:
                    if known is not None and (rest := step([], end)):
                        yield told(rest)
                    known, inner = owners[a], None
                part = list(zip(*[c[a:b] for c in columns]))
                # rows of the last time may go on in the next batch
                if made := step(part, part[-1][0] - 1):
                    yield told(made)
        if known is not None and (rest := step([], end)):
            yield told(rest)

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, ts, *tie)
    return ordered.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in schema))
