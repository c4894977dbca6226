"""Poll cycles: the parts that the walkers of a device report one by one, put together into one row a cycle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeutil import interval_us, ts_plus
from .machines import Machine, Rows, in_chunks
from .series import _POS

# The walkers that make up a system row, and how long a cycle waits for one that does not report.
WALKERS = ("cpu", "storage", "temp")
TIMEOUT = "35 seconds"


class PollCycles(Machine):
    """Gives every part the position of the first part of its cycle.

    A cycle begins with the first part after the one before it closed. It closes with the part that makes its walkers
    complete, else `timeout` after its first part. The state is (position of the first part, its time, walkers so far),
    or None while no cycle is open.
    """

    def __init__(self, ts: str, walkers: tuple[str, ...], timeout: str):
        self.ts, self.bits, self.timeout = ts, {w: 1 << i for i, w in enumerate(walkers)}, interval_us(timeout)
        self.full, self.columns = (1 << len(walkers)) - 1, (ts, "walker", _POS)

    def run(self, state, rows: Rows):
        first, since, seen = state or (None, 0, 0)
        times, bits, at = rows[self.ts].tolist(), [self.bits[w] for w in rows["walker"]], rows[_POS].tolist()
        out = np.empty(len(at), np.int64)
        for j, t in enumerate(times):
            if first is None or t >= since + self.timeout:
                first, since, seen = at[j], t, 0
            out[j] = first
            seen |= bits[j]
            if seen == self.full:
                first = None
        return {"cycle": out}, (first, since, seen) if first is not None else None

    def summary(self, rows: Rows):
        """The parts of the chunk's first `timeout`, among which a cycle open before must close, and for a cycle that
        begins at each of them the state at the chunk's end."""
        times, bits, at = rows[self.ts], np.array([self.bits[w] for w in rows["walker"]]), rows[_POS]
        n = len(times)
        # where each walker reports next, from every part on
        nexts = []
        for b in self.bits.values():
            of = np.flatnonzero(bits == b)
            nexts.append(np.append(of, n)[np.searchsorted(of, np.arange(n))])
        complete = np.max(nexts, axis=0)
        out_of_time = np.searchsorted(times, times + self.timeout)
        whole = complete < out_of_time
        following = np.where(whole, complete + 1, out_of_time)
        head = int(np.searchsorted(times, times[0] + self.timeout))
        ends: dict[int, tuple | None] = {n: None}

        def end_from(i: int) -> tuple | None:
            path = []
            while i not in ends:
                path.append(i)
                if following[i] == n and not whole[i]:
                    ends[i] = (int(at[i]), int(times[i]), int(np.bitwise_or.reduce(bits[i:])))
                    break
                i = int(following[i])
            for j in path:
                ends[j] = ends[i]
            return ends[i]

        return times[:head].tolist(), bits[:head].tolist(), [end_from(i) for i in range(head + 1)], head == n

    def advance(self, state, summary):
        times, bits, ends, all_of_it = summary
        if state is None:
            return ends[0]
        first, since, seen = state
        for j, (t, b) in enumerate(zip(times, bits)):
            if t >= since + self.timeout:
                return ends[j]
            seen |= b
            if seen == self.full:
                return ends[j + 1]
        # the part after the first `timeout` begins a cycle in any case
        return (first, since, seen) if all_of_it else ends[len(times)]


def poll_cycles(parts: DataFrame, timeout: str = TIMEOUT, walkers: tuple[str, ...] = WALKERS, ts: str = "ts", tie: str = "walker", max_rows: int | None = None) -> DataFrame:
    """One row for each device and poll cycle: when it began and closed, whether it is complete, who reported, the readings.

    `parts` has device_id, `ts`, walker, `tie` (which orders parts of one time) and readings, NULL where a walker has
    none; each reading is the cycle's newest. Parts of other walkers are left out. A cycle closes at the part that
    completes it, else `timeout` after it began, with what has come: polls that follow each other closely stay apart, and
    a walker that never reports costs its own readings only.
    """
    own = parts.where(F.col("walker").isin(list(walkers)) & F.col(ts).isNotNull())
    marked = in_chunks(own, ["device_id"], list(dict.fromkeys([ts, tie, "walker"])), PollCycles(ts, walkers, timeout), {"cycle": "long"}, max_rows)
    return closed_cycles(marked, timeout, walkers, ts, tie)


def closed_cycles(marked: DataFrame, timeout: str, walkers: tuple[str, ...], ts: str, tie: str) -> DataFrame:
    """Rows of cycles from parts that know their `cycle`."""
    cols = [c for c in marked.columns if c not in ("device_id", ts, "walker", tie, "cycle")]
    out = marked.groupBy("device_id", "cycle").agg(
        F.min(ts).alias("cycle_start"), F.max(ts).alias("last_part"), F.sort_array(F.collect_set("walker")).alias("walkers"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in cols],
    )
    complete = F.size("walkers") == len(walkers)
    closed = F.when(complete, F.col("last_part")).otherwise(ts_plus("cycle_start", interval_us(timeout)))
    return out.select("device_id", "cycle_start", closed.alias("closed_at"), complete.alias("complete"), "walkers", *cols)
