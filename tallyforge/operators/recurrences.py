"""Recurrences along a history as machines that run in chunks: smoothing, one-sided sums, cooldowns, held conditions,
half averages and last known values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeutil import interval_us
from .machines import Machine, in_chunks


# up to this many values a plain loop is faster than pandas
_SHORT = 64


def _level_after(v: np.ndarray, z: float | None, lam: float) -> np.ndarray:
    """`level_after` value by value, with the very steps of pandas."""
    out, keep = np.empty(len(v)), 1 - lam
    for i, x in enumerate(v.tolist()):
        if z is None:
            z = x
        elif z != x:
            z = (keep * z + lam * x) / (keep + lam)
        out[i] = z
    return out


def level_after(v: np.ndarray, z: float | None, lam: float) -> np.ndarray:
    """z_t = lam v_t + (1 - lam) z_{t-1} along `v`, from the level `z` before it (None: the first value is the level)."""
    if len(v) <= _SHORT and np.isfinite(v).all():
        return _level_after(v, z, lam)
    whole = v if z is None else np.concatenate([[z], v])
    out = pd.Series(whole).ewm(alpha=lam, adjust=False).mean().to_numpy()
    return out if z is None else out[1:]


def _filled(values: np.ndarray, known: np.ndarray, before: float | None) -> np.ndarray:
    """`values` of the rows in `known`, each carried on over the rows after it that have none."""
    at = np.cumsum(known) - 1
    return np.append(values, np.nan if before is None else before)[at]


class Smoothing(Machine):
    """`out` = lam x + (1 - lam) out before; the first reading is the first level. A row without a reading keeps the level."""

    def __init__(self, x: str, lam: float, out: str):
        self.columns, self.lam, self.out = (x,), lam, out

    def run(self, state, rows):
        x = rows[self.columns[0]]
        known = ~np.isnan(x)
        levels = level_after(x[known], state, self.lam)
        return {self.out: _filled(levels, known, state)}, float(levels[-1]) if len(levels) else state

    def summary(self, rows):
        x = rows[self.columns[0]]
        x = x[~np.isnan(x)]
        if not len(x):
            return None
        return (1 - self.lam) ** len(x), float(level_after(x, 0.0, self.lam)[-1]), float(level_after(x, None, self.lam)[-1])

    def advance(self, state, summary):
        if summary is None:
            return state
        keep, own, fresh = summary
        return fresh if state is None else own + keep * state


def smoothed(df: DataFrame, keys: list[str], order: list[str], x: str, lam: float, out_col: str = "ewma", max_rows: int | None = None) -> DataFrame:
    """z_t = lam x_t + (1-lam) z_{t-1}, z_0 = x_0 per key, in column `out_col`.

    A NULL or NaN reading leaves the level as it is; before the first reading there is none (NaN becomes NULL).
    """
    out = in_chunks(df, keys, order, Smoothing(x, lam, out_col), {out_col: "double"}, max_rows)
    return out.withColumn(out_col, F.nanvl(out_col, F.lit(None).cast("double")))


class OneSided(Machine):
    """c = max(0, c before + step) for both columns of steps; a missing step is 0."""

    columns = ("_up", "_down")

    def _steps(self, rows):
        return [np.cumsum(np.nan_to_num(rows[c], nan=0.0)) for c in self.columns]

    def run(self, state, rows):
        out, ends = {}, []
        for name, s, c in zip(("cusum_pos", "cusum_neg"), self._steps(rows), state or (0.0, 0.0)):
            # either never at zero since the state, or at zero where the sum was least
            out[name] = np.maximum(s + c, s - np.minimum.accumulate(s))
            ends.append(float(out[name][-1]))
        return out, tuple(ends)

    def summary(self, rows):
        return [(float(s[-1]), float(s[-1] - s.min())) for s in self._steps(rows)]

    def advance(self, state, summary):
        return tuple(max(c + total, least) for c, (total, least) in zip(state or (0.0, 0.0), summary))


def one_sided_sums(df: DataFrame, keys: list[str], order: list[str], up: Column, down: Column, max_rows: int | None = None) -> DataFrame:
    """`cusum_pos` / `cusum_neg`: c_t = max(0, c_{t-1} + step_t)."""
    steps = df.withColumns({"_up": up.cast("double"), "_down": down.cast("double")})
    return in_chunks(steps, keys, order, OneSided(), {"cusum_pos": "double", "cusum_neg": "double"}, max_rows).drop("_up", "_down")


class Cooldown(Machine):
    """`fired`: whether a row comes when the cooldown of the last one that fired is over. The state is when that is."""

    def __init__(self, ts: str, cooldown: str):
        self.columns, self.us = (ts,), interval_us(cooldown)

    def run(self, state, rows):
        times = rows[self.columns[0]]
        fired = np.zeros(len(times), bool)
        i = 0 if state is None else int(np.searchsorted(times, state))
        while i < len(times):
            fired[i], state = True, int(times[i]) + self.us
            i = int(np.searchsorted(times, state))
        return {"fired": fired}, state

    def summary(self, rows):
        """The times of the chunk's first cooldown, and for each of them, if it fires, when the last cooldown ends."""
        times = rows[self.columns[0]]
        n, head = len(times), int(np.searchsorted(times, times[0] + self.us))
        following = np.searchsorted(times, times + self.us)
        ends: dict[int, int] = {}
        for i in range(min(head, n - 1) + 1):
            path = [i]
            while path[-1] not in ends and following[path[-1]] < n:
                path.append(int(following[path[-1]]))
            end = ends.get(path[-1], int(times[path[-1]]) + self.us)
            for j in path:
                ends[j] = end
        return times[:head].tolist(), [ends[i] for i in range(min(head, n - 1) + 1)]

    def advance(self, state, summary):
        times, ends = summary
        i = 0 if state is None else int(np.searchsorted(times, state))
        return ends[i] if i < len(ends) else state


class Held(Machine):
    """`out`: when the run of true conditions began that holds at a row, -1 without one; a gap above `grid` breaks it."""

    def __init__(self, ts: str, cond: str, grid: int, out: str = "since"):
        self.columns, self.grid, self.out = (ts, cond), grid, out

    def _parts(self, state, rows):
        times, cond = rows[self.columns[0]], np.array([c is not None and bool(c) for c in rows[self.columns[1]]])
        since, last, was = state or (-1, times[0] - self.grid - 1, False)
        before = np.append(was, cond[:-1]) & (np.diff(times, prepend=last) <= self.grid)
        return times, cond, cond & ~before, since

    def run(self, state, rows):
        times, cond, begins, since = self._parts(state, rows)
        at = np.maximum.accumulate(np.where(begins, np.arange(len(times)), -1))
        out = np.where(cond, np.where(at >= 0, times[at], since), -1).astype(np.int64)
        return {self.out: out}, (int(out[-1]), int(times[-1]), bool(cond[-1]))

    def summary(self, rows):
        times, cond, begins, _ = self._parts(None, rows)
        _, end = self.run(None, rows)
        return int(times[0]), bool(cond.all() and begins.sum() == 1), end

    def advance(self, state, summary):
        first, unbroken, end = summary
        goes_on = state is not None and unbroken and state[2] and first - state[1] <= self.grid
        return (state[0], *end[1:]) if goes_on else end


class Recent(Machine):
    """`out`: the mean of `x` over the rows of the last `span` microseconds, the row itself included; missing ones do not count.

    The state is those rows: times and values.
    """

    def __init__(self, ts: str, x: str, span: int, out: str):
        self.columns, self.span, self.out = (ts, x), span, out

    def _end(self, times, x):
        near = times > times[-1] - self.span
        return times[near], x[near]

    def run(self, state, rows):
        times, x = (rows[c] for c in self.columns)
        n = len(times)
        if state is not None:
            times, x = np.append(state[0], times), np.append(state[1], x)
        from_ = np.searchsorted(times, times - self.span, "right")
        known = ~np.isnan(x)
        sums, counts = np.append(0.0, np.cumsum(np.where(known, x, 0.0))), np.append(0, np.cumsum(known))
        to = np.arange(1, len(times) + 1)
        with np.errstate(invalid="ignore"):
            mean = (sums[to] - sums[from_]) / (counts[to] - counts[from_])
        return {self.out: mean[len(times) - n :]}, self._end(times, x)

    def summary(self, rows):
        return self._end(*(rows[c] for c in self.columns))

    def advance(self, state, summary):
        return summary if state is None else self._end(np.append(state[0], summary[0]), np.append(state[1], summary[1]))


def _halved(v: np.ndarray, z: float | None) -> np.ndarray:
    """Mean of each reading and the level before it; a level of exactly zero is replaced by the reading."""
    out, i, z = np.empty(len(v)), 0, z or 0.0
    while i < len(v):
        if z == 0:
            z = out[i] = v[i]
            i += 1
            continue
        levels = level_after(v[i:], z, 0.5)
        zeros = np.flatnonzero(levels == 0)
        n = int(zeros[0]) + 1 if len(zeros) else len(levels)
        out[i : i + n] = levels[:n]
        i, z = i + n, out[i + n - 1]
    return out


class HalfAverage(Machine):
    """`out` after each row: every reading of its columns `x`, from left to right, is averaged with the level before it.

    The state is the level; a missing reading leaves it. A level halves with every reading, so none reaches past `_HEAD`
    readings but for the last bit of a rounding: a longer chunk ends on the same level whatever it began with.
    """

    _HEAD = 2200

    def __init__(self, x: str | tuple[str, ...], out: str):
        self.columns, self.out = (x,) if isinstance(x, str) else x, out

    def _readings(self, rows):
        x = np.stack([rows[c] for c in self.columns], axis=1).reshape(-1)
        return x, ~np.isnan(x)

    def run(self, state, rows):
        x, known = self._readings(rows)
        levels = _halved(x[known], state)
        after = _filled(levels, known, state)[len(self.columns) - 1 :: len(self.columns)]
        return {self.out: after}, float(levels[-1]) if len(levels) else state

    def summary(self, rows):
        x, known = self._readings(rows)
        x = x[known]
        return x[: self._HEAD], float(_halved(x, None)[-1]) if len(x) > self._HEAD else None

    def advance(self, state, summary):
        head, end = summary
        if end is not None:
            return end
        return float(_halved(head, state)[-1]) if len(head) else state


def half_average(df: DataFrame, keys: list[str], order: list[str], x: str, out: str, max_rows: int | None = None) -> DataFrame:
    """Running half average kept across readings: the mean of the reading and the level before it; a zero level restarts.

    Rows without a reading carry no level and are left out.
    """
    return in_chunks(df.where(F.col(x).isNotNull()), keys, order, HalfAverage(x, out), {out: "double"}, max_rows)


class LastKnown(Machine):
    """Each of `last` as of its newest reading, each of `top` as the largest so far; one state for all of them."""

    def __init__(self, last: tuple[str, ...], top: tuple[str, ...] = ()):
        self.last, self.top, self.columns = last, top, (*last, *top)

    def run(self, state, rows):
        state, out = state or {}, {}
        for c in self.last:
            known = ~np.isnan(rows[c])
            out[f"{c}_now"] = _filled(rows[c][known], known, state.get(c))
        for c in self.top:
            out[f"{c}_now"] = np.fmax.accumulate(np.fmax(rows[c], state.get(c, np.nan)))
        return out, {c: float(v[-1]) for c in self.columns if not np.isnan((v := out[f"{c}_now"])[-1])}

    def summary(self, rows):
        return self.run(None, rows)[1]

    def advance(self, state, summary):
        top = {c: max(state[c], summary[c]) for c in self.top if state and c in state and c in summary}
        return {**(state or {}), **summary, **top}


class Together(Machine):
    """Several machines over the same rows, in one pass and one layout."""

    def __init__(self, *machines: Machine):
        self.machines, self.columns = machines, tuple(dict.fromkeys(c for m in machines for c in m.columns))

    def run(self, state, rows):
        each = [m.run(s, rows) for m, s in zip(self.machines, state or [None] * len(self.machines))]
        return {c: v for made, _ in each for c, v in made.items()}, [s for _, s in each]

    def summary(self, rows):
        return [m.summary(rows) for m in self.machines]

    def advance(self, state, summary):
        return [m.advance(s, x) for m, s, x in zip(self.machines, state or [None] * len(self.machines), summary)]
