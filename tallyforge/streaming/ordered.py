"""Keyed state machines on streams whose result does not depend on how the input is cut into micro-batches.

Rows wait in their key's state until the watermark has passed them and are then handed over in order of time, so rows
that arrive out of order, within the watermark, end up where the batch operator has them. Timers are event times. The
state of a key holds the rows of one watermark delay and what its machine needs; it goes when the machine says so.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeutil import interval_us
from ..operators.cycles import TIMEOUT, WALKERS
from ..operators.machines import Fold, Machine
from ..operators.notify import Notifier, Route
from ..sources.varbinds import WALK_STATE, shown_state, walk_machine, walk_readings
from .keyed import each_key


def in_order(df: DataFrame, keys: list[str], ts: str, tie: list[str], cols: list[str], watermark: str | None, fold: Fold, out: dict[str, str]) -> DataFrame:
    """Run `fold` over each key of a stream; `out` names the emitted columns after the keys and their types.

    Rows older than the watermark when they come are dropped, as in every windowed aggregation. Rows of one time are
    ordered by `tie`, which should make them unique. Without a `watermark` those hold that the input has.
    """
    names = list(dict.fromkeys([ts, *tie, *cols]))
    order = [0, *[names.index(t) for t in tie]]

    def of(row: tuple) -> tuple:
        return tuple((row[i] is not None, row[i]) for i in order)

    def each(key: tuple, came: list[tuple], state: tuple | None, now_ms: int) -> tuple[tuple | None, list[tuple], int | None]:
        held, inner = state or ([], None)
        now = now_ms * 1000
        if came:
            held = sorted([*held, *came], key=of)
        ready = sum(1 for r in held if r[0] <= now)
        inner, emitted = fold.rows(key, inner, held[:ready], now)
        held = held[ready:]
        if not held and inner is None:
            return None, emitted, None
        wakes = [t for t in (held[0][0] if held else None, fold.due(inner) if inner is not None else None) if t is not None]
        return (held, inner), emitted, max(-(-min(wakes) // 1000), now_ms + 1) if wakes else None

    rows = df.where(f"`{ts}` IS NOT NULL")
    rows = (rows.withWatermark(ts, watermark) if watermark else rows).select(*dict.fromkeys([*keys, *names]))
    return each_key(rows, keys, names, each, out, timed=True)


class _Rows(Fold):
    """Runs a machine of the batch operators over released rows; a key is forgotten `keep` after its last row."""

    def __init__(self, machine: Machine, at: dict[str, int], keep: int):
        self.machine, self.at, self.keep = machine, at, keep

    def rows(self, key, inner, batch, now):
        if batch:
            arrays = {c: np.array([np.nan if r[i] is None else r[i] for r in batch]) for c, i in self.at.items()}
            made, state = self.machine.run(inner and inner[0], arrays)
            added = zip(*[v.tolist() for v in made.values()])
            return (state, batch[-1][0]), [(*r, *a) for r, a in zip(batch, added)]
        return (None if inner and now >= inner[1] + self.keep else inner), []

    def due(self, inner):
        return inner[1] + self.keep


def machine_stream(df: DataFrame, keys: list[str], ts: str, tie: list[str], cols: list[str], machine: Machine, added: dict[str, str], watermark: str, keep: str = "7 days") -> DataFrame:
    """`machines.in_chunks` on a stream: every row, in order, with what the machine adds to it.

    A key that is quiet for `keep` of event time is forgotten and begins anew.
    """
    names = list(dict.fromkeys([ts, *tie, *cols]))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    at = {c: names.index(c) for c in machine.columns}
    return in_order(df, keys, ts, tie, cols, watermark, _Rows(machine, at, interval_us(keep)), {**{n: types[n] for n in names}, **added})


def device_state_stream(walks: DataFrame, watermark: str = "1 minute", keep: str = "7 days") -> DataFrame:
    """`varbinds.device_state` on a stream of whole walks (device_id, ts, walker, items)."""
    readings = walk_readings(walks)
    cols = [c for c in readings.columns if c not in ("device_id", "ts", "walker")]
    return shown_state(machine_stream(readings, ["device_id"], "ts", ["walker"], cols, walk_machine(), WALK_STATE, watermark, keep))


class _Cycles(Fold):
    def __init__(self, walkers: tuple[str, ...], timeout: str, at: int, n: int):
        self.walkers, self.timeout, self.at, self.n = set(walkers), interval_us(timeout), at, n

    def rows(self, key, inner, batch, now):
        """The inner state is the cycle that is open: first and last time, walkers, readings."""
        out: list[tuple] = []

        def close(at: int) -> None:
            first, _, seen, values = inner
            out.append((first, at, seen == self.walkers, sorted(seen), *values))

        for row in batch:
            t, walker, values_now = row[0], row[self.at], row[self.at + 1 :]
            if inner and t >= inner[0] + self.timeout:
                close(inner[0] + self.timeout)
                inner = None
            first, _, seen, values = inner or (t, t, set(), [None] * self.n)
            inner = first, t, seen | {walker}, [old if v is None else v for v, old in zip(values_now, values)]
            if inner[2] == self.walkers:
                close(t)
                inner = None
        if inner and now >= inner[0] + self.timeout:
            close(inner[0] + self.timeout)
            inner = None
        return inner, out

    def due(self, inner):
        return inner[0] + self.timeout


def poll_cycles_stream(parts: DataFrame, timeout: str = TIMEOUT, walkers: tuple[str, ...] = WALKERS, ts: str = "ts", tie: str = "walker", watermark: str = "1 minute") -> DataFrame:
    """`cycles.poll_cycles` on a stream: a cycle is told when it is complete or its time is over; then its state goes."""
    cols = [c for c in parts.columns if c not in ("device_id", ts, "walker", tie)]
    types = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    own = parts.where(parts["walker"].isin(list(walkers)))
    order = list(dict.fromkeys([tie, "walker"]))
    out = {"cycle_start": "timestamp", "closed_at": "timestamp", "complete": "boolean", "walkers": "array<string>", **{c: types[c] for c in cols}}
    return in_order(own, ["device_id"], ts, order, ["walker", *cols], watermark, _Cycles(walkers, timeout, len(order), len(cols)), out)


class _Rises(Fold):
    """The inner state: the last known reading, what the buckets that are open have risen by, and the last row's time."""

    def __init__(self, width: int, keep: int):
        self.width, self.keep = width, keep

    def rows(self, key, inner, batch, now):
        known, risen, seen = inner or (None, {}, 0)
        for t, v in batch:
            bucket, seen = t - t % self.width, t
            step = 0.0 if v is None or known is None else v - known if v >= known else v
            risen[bucket] = risen.get(bucket, 0.0) + step
            known = known if v is None else v
        out = [(b, risen.pop(b) * 1e6 / self.width) for b in sorted(risen) if b + self.width <= now]
        return (None if not risen and now >= seen + self.keep else (known, risen, seen)), out

    def due(self, inner):
        _, risen, seen = inner
        return min(risen) + self.width if risen else seen + self.keep


def rate_stream(counter: DataFrame, keys: list[str], ts: str, value: str, width: str = "5 minutes", watermark: str = "1 minute", keep: str = "1 day") -> DataFrame:
    """`infra.rate_over` on a stream: the rate of each bucket once the watermark has passed it.

    The state of a counter is its last reading, its open buckets and the readings of one watermark delay; a counter that
    is quiet for `keep` is forgotten.
    """
    rows = counter.withColumn("_v", counter[value].cast("double"))
    return in_order(rows, keys, ts, ["_v"], ["_v"], watermark, _Rises(interval_us(width), interval_us(keep)), {"bucket": "timestamp", "rate": "double"})


def notifications_stream(alerts: DataFrame, routes: dict[str, Route] | None = None, watermark: str = "1 minute") -> DataFrame:
    """`notify.notifications` on a stream: each notification once the watermark has passed its time.

    A device without an active alert and with all its groups told of leaves no state.
    """
    return in_order(alerts, ["device_id"], "ts", list(Notifier.ORDER), list(Notifier.COLUMNS), watermark, Notifier(routes), Notifier.OUT)


class _Lifecycle(Fold):
    """The inner state: the alarm's status, and when anything last happened to it."""

    ALLOWED = {"ACKNOWLEDGED": ("OPEN",), "RESOLVED": ("OPEN", "ACKNOWLEDGED")}

    def __init__(self, keep: int):
        self.keep = keep

    def rows(self, key, inner, batch, now):
        out = []
        for t, later, _, action_id, action, actor in batch:
            if not later:
                inner = inner or ("OPEN", t)
                continue
            if inner is None:
                out.append((action_id, action, None, "unknown alarm"))
                continue
            status, reason = inner[0], None
            if status == "RESOLVED":
                reason = "RESOLVED is final"
            elif action not in self.ALLOWED:
                reason = f"no transition to {action}"
            elif not (actor or "").strip():
                reason = "actor required"
            elif status not in self.ALLOWED[action]:
                reason = "not OPEN"
            inner = (status if reason else action, t)
            out.append((action_id, action, inner[0], reason))
        over = inner is not None and inner[0] == "RESOLVED" and now >= inner[1] + self.keep
        return None if over else inner, out

    def due(self, inner):
        return inner[1] + self.keep if inner[0] == "RESOLVED" else None


def lifecycle_stream(alarms: DataFrame, actions: DataFrame, watermark: str = "5 minutes", keep: str = "30 days") -> DataFrame:
    """Every action with the status it led to, or why it was rejected; alarms and actions are two streams.

    An action waits until the watermarks of both streams have passed the birth of its alarm: if none came by then the
    alarm is unknown. A resolved alarm is forgotten `keep` after its last action; open ones stay, unknown ones
    leave nothing.
    """
    born = alarms.select("logdate", "logid", F.col("logdate").alias("ts"), F.lit(True).alias("born"), F.lit(None).cast("timestamp").alias("asked"), *[F.lit(None).cast("string").alias(c) for c in ("action_id", "action", "actor")])
    asked = actions.select("logdate", "logid", F.greatest("action_ts", "logdate").alias("ts"), F.lit(False).alias("born"), F.col("action_ts").alias("asked"), "action_id", "action", "actor")
    # a watermark on either side: the one that lags holds for both
    both = born.withWatermark("ts", watermark).unionByName(asked.withWatermark("ts", watermark)).withColumn("later", ~F.col("born"))
    out = {"action_id": "string", "action": "string", "status": "string", "reason": "string"}
    return in_order(both, ["logdate", "logid"], "ts", ["later", "asked", "action_id"], ["action", "actor"], None, _Lifecycle(interval_us(keep)), out)
