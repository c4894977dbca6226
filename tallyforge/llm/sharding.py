"""Shards of equal bytes: best-fit-decreasing packing of indivisible groups, the rows of one text.

Packing goes in two steps, so that no task sees all groups. Each partition packs its own groups, largest first, into
bundles; a bundle holds a fiftieth of a shard at most, and a part of the groups goes into bundles sixteen times smaller,
which level the shards out in the end. The bundles, at most a few hundred per shard whatever the input, are then packed
into shards the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, rejoined, shielded, written

ROW_BYTES = 16
BUNDLES_A_SHARD = 50
_FINE = 16
_SLOT_SLICES = 256


class Capacities:
    """Bins by remaining capacity in a balanced tree (a treap; priorities from a fixed generator)."""

    def __init__(self):
        self.key, self.left, self.right, self.rank = [None], [0], [0], [0]
        self.free: list[int] = []
        self.root, self.state = 0, 0x9E3779B97F4A7C15

    def _node(self, key: tuple[int, int]) -> int:
        self.state = (self.state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        if self.free:
            n = self.free.pop()
            self.key[n], self.left[n], self.right[n], self.rank[n] = key, 0, 0, self.state
            return n
        for column, x in ((self.key, key), (self.left, 0), (self.right, 0), (self.rank, self.state)):
            column.append(x)
        return len(self.key) - 1

    def _split(self, n: int, key: tuple[int, int]) -> tuple[int, int]:
        """Keys below `key`, and the others."""
        if not n:
            return 0, 0
        if self.key[n] < key:
            self.right[n], b = self._split(self.right[n], key)
            return n, b
        a, self.left[n] = self._split(self.left[n], key)
        return a, n

    def _join(self, a: int, b: int) -> int:
        if not a or not b:
            return a or b
        if self.rank[a] > self.rank[b]:
            self.right[a] = self._join(self.right[a], b)
            return a
        self.left[b] = self._join(a, self.left[b])
        return b

    def add(self, remaining: int, bin_: int) -> None:
        a, b = self._split(self.root, (remaining, bin_))
        self.root = self._join(self._join(a, self._node((remaining, bin_))), b)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least capacity that still holds `size`."""
        a, b = self._split(self.root, (size, -1))
        if not b:
            self.root = a
            return None
        up, n = 0, b
        while self.left[n]:
            up, n = n, self.left[n]
        if up:
            self.left[up] = self.right[n]
        else:
            b = self.right[n]
        self.root = self._join(a, b)
        self.free.append(n)
        return self.key[n]


class BestFit:
    """Best fit for sizes that come in falling order; a size over the capacity has a bin of its own."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.open = capacity, 0, Capacities()

    def place(self, size: int) -> int:
        found = self.open.take_tightest(size) if size <= self.capacity else None
        if found:
            remaining, bin_ = found
        else:
            remaining, bin_, self.bins = max(self.capacity, size), self.bins, self.bins + 1
        if remaining > size:
            self.open.add(remaining - size, bin_)
        return bin_


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Bins for sizes in falling order."""
    bins = BestFit(capacity)
    return [bins.place(s) for s in sizes]


def pack_evenly(sizes: list[int], n: int) -> list[int]:
    """Bins 0..n-1 for sizes in falling order, filled as evenly as best fit can.

    Whatever exceeds an even share of what is left has a bin alone; the rest is packed with the least capacity that
    needs no more bins than there are.
    """
    alone, left = 0, sum(sizes)
    while alone < min(n - 1, len(sizes)) and sizes[alone] * (n - alone) > left:
        left -= sizes[alone]
        alone += 1
    rest, bins = sizes[alone:], n - alone
    if not rest:
        return list(range(alone))
    low = max(-(-left // bins), rest[0])
    high = low + rest[0]
    best = None
    while low <= high:
        middle = (low + high) // 2
        placed = pack(rest, middle)
        if max(placed) < bins:
            best, high = placed, middle - 1
        else:
            low = middle + 1
    while best is None:
        high = high * 2 + 1
        placed = pack(rest, high)
        best = placed if max(placed) < bins else None
    return [*range(alone), *(alone + b for b in best)]


def _bundles(unit: int, fine: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        coarse, small = BestFit(unit), BestFit(max(1, unit // _FINE))
        for batch in batches:
            out = []
            for h, size in zip(batch.column("h").to_pylist(), batch.column("bytes").to_pylist()):
                if fine and h % _FINE == 0 and size <= small.capacity:
                    out.append(base + small.place(size) * 2 + 1)
                else:
                    out.append(base + coarse.place(size) * 2)
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("bytes"), pa.array(out, pa.int64())], ["h", "bytes", "bundle"])

    return run


def _together(n_shards: int | None, capacity: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b, x) for batch in batches for b, x in zip(batch.column("bytes").to_pylist(), batch.column("bundle").to_pylist())]
        rows.sort(key=lambda r: (-r[0], r[1]))
        sizes = [r[0] for r in rows]
        placed = pack_evenly(sizes, n_shards) if n_shards else pack(sizes, capacity)
        yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array(placed, pa.int64())], ["bundle", "shard"])

    return run


def _packed(groups: DataFrame, unit: int, fine: bool) -> DataFrame:
    """(h, bytes, bundle): every partition packs its own groups; open bins are all that a task keeps."""
    sorted_ = groups.repartition("h").sortWithinPartitions(F.desc("bytes"), "h")
    return written(sorted_.mapInArrow(_bundles(unit, fine), "h long, bytes long, bundle long"), "bundles")


def assign(groups: DataFrame, n_shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """(h, shard) for groups (h, bytes): `n_shards` even shards, or as few shards of `capacity` bytes as best fit needs.

    With a capacity, bins that a partition has filled to 95 % are shards; only the others are packed once more together.
    """
    if n_shards:
        total = groups.agg(F.sum("bytes")).first()[0] or 0
        unit = max(1, total // (n_shards * BUNDLES_A_SHARD))
        packed = _packed(groups, unit, True)
        per = packed.groupBy("bundle").agg(F.sum("bytes").alias("bytes"))
        shards = per.coalesce(1).mapInArrow(_together(n_shards, None), "bundle long, shard long")
    else:
        packed = _packed(groups, capacity, False)
        per = packed.groupBy("bundle").agg(F.sum("bytes").alias("bytes"))
        again = per.where(F.col("bytes") < int(capacity * 0.95)).coalesce(1).mapInArrow(_together(None, capacity), "bundle long, shard long")
        done = per.where(F.col("bytes") >= int(capacity * 0.95)).select("bundle", (-F.col("bundle") - 1).alias("shard"))
        shards = again.unionByName(done)
        names = shards.select("shard").distinct().withColumn("n", F.row_number().over(Window.orderBy("shard")) - 1)
        shards = shards.join(names, "shard").select("bundle", F.col("n").alias("shard"))
    return packed.join(written(shards, "shards"), "bundle").select("h", "shard")


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` with slot, gapless from 0 within each shard: counts of slices of a shard, then a number within the slice."""
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "__h"), F.lit(_SLOT_SLICES)))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "slice").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    in_slice = Window.partitionBy("shard", "slice").orderBy("doc_id", "__h", "__turn")
    placed = rows.withColumn("place", F.row_number().over(in_slice))
    return placed.join(starts, ["shard", "slice"]).withColumn("slot", F.col("start") + F.col("place") - 1).drop("slice", "start", "place")


def shard_plan(docs: DataFrame, n_shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """(doc_id, __h, __turn, size, text_crc32, shard, slot) for every row of `docs`.

    A row's size is the UTF-8 bytes of its text plus 16 (a null text: 16, and no crc). Rows of equal text form a group
    and share a shard; null texts are one group, empty texts another. A group larger than an even share has a shard to
    itself and the rest is even among the other shards. An empty table gives no row.
    """
    text = F.col("text").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("__h"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = written(keyed(rows), "rows")
    groups = rows.groupBy(F.col("__h").alias("h")).agg(F.sum("size").alias("bytes"))
    placed = rows.join(assign(written(groups, "groups"), n_shards, capacity), F.col("__h") == F.col("h")).drop("h")
    return numbered(placed)


def shard(docs: DataFrame, n_shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """`docs` with the columns shard and slot, in place of such columns if it has them; other names do not matter."""
    inner, _ = shielded(docs.drop("shard", "slot"), "doc_id", "text")
    plan = shard_plan(inner, n_shards, capacity).select("doc_id", "__h", "__turn", F.struct("shard", "slot").alias("__place"))
    placed = rejoined(inner, plan)
    kept = [F.col(n).alias(c) for n, c in zip(inner.columns, docs.drop("shard", "slot").columns)]
    return placed.select(*kept, "__place.shard", "__place.slot")
