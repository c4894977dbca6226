"""Benchmark decontamination: Wu-Manber search for all windows of all benchmark items at once, over words.

A symbol is a word, a block is two words. The shift table says how far the search may jump past a block, blocks that
end a window (shift 0) lead to the bucket of windows with that last block, and each of these is compared word by word
and then byte by byte. Many positions of a text are searched side by side, each in a stretch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shielded, written
from .words import LETTERS_DIGITS, Cutter, Words, lower_ascii, mix

WINDOW = 10
#: windows held by one broadcast; a larger benchmark is searched in several passes
WINDOWS_A_PASS = 200_000
_TABLE_BITS = 18
_STRETCH = 256
_LOWER = bytes(lower_ascii())
_FOUND = "__n_words long, __spans array<struct<start:long,end:long>>, __items array<string>"


def _cutter() -> Cutter:
    return Cutter(LETTERS_DIGITS, lower_ascii())


def _normal(words: Words, first: int, last: int) -> bytes:
    """Words first..last as lower-case bytes with one space between them."""
    data = words.data
    return b" ".join(data[a:b].tobytes() for a, b in zip(words.starts[first : last + 1], words.ends[first : last + 1])).translate(_LOWER)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = _cutter()
    for batch in batches:
        for w in cutter.words(batch.column("text")):
            ids, first = batch.column("item").slice(w.lo, w.hi - w.lo).to_pylist(), 0
            rows = []
            for item, n in zip(ids, w.counts.tolist()):
                m = min(WINDOW, n)
                rows += [(item, m, _normal(w, first + i, first + i + m - 1)) for i in range(n - m + 1) if n]
                first += n
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["item", "m", "words"])


def windows(benchmark: DataFrame) -> DataFrame:
    """(item, m, words): every run of 10 consecutive words of each item; an item of fewer words is one window.

    Items without a word give none; the windows of an item whose id is null are searched like all others.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(_windows, "item string, m int, words binary").distinct()


@dataclass
class Patterns:
    """Windows of one length, ready to search."""

    m: int
    block: int
    shift: np.ndarray
    suffixes: np.ndarray
    bounds: np.ndarray
    symbols: np.ndarray
    texts: list[bytes]

    @classmethod
    def of(cls, m: int, texts: list[bytes]) -> Patterns:
        column = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        symbols = np.concatenate([w.hashes for w in _cutter().words(column)]).reshape(-1, m)
        block = min(2, m)
        values = _blocks(symbols, block)
        shift = np.full(1 << _TABLE_BITS, m - block + 1, np.uint8 if m < 256 else np.int64)
        for j in range(values.shape[1]):
            np.minimum.at(shift, _slot(values[:, j]), m - block - j)
        order = np.argsort(values[:, -1], kind="stable")
        suffixes, first = np.unique(values[order, -1], return_index=True)
        return cls(m, block, shift, suffixes, np.append(first, len(order)), symbols[order], [texts[i] for i in order])


def _blocks(symbols: np.ndarray, block: int) -> np.ndarray:
    return symbols if block == 1 else mix(symbols[..., :-1] * np.uint64(31) + symbols[..., 1:])


def _slot(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def _ends(p: Patterns, symbols: np.ndarray) -> np.ndarray:
    """Positions of last words whose block ends some window: cursors in stretches jump by the shift table."""
    n = len(symbols)
    at = np.arange(p.m - 1, n, _STRETCH)
    stop = np.minimum(at + _STRETCH, n)
    found = []
    while len(at):
        value = symbols[at] if p.block == 1 else mix(symbols[at - 1] * np.uint64(31) + symbols[at])
        jump = p.shift[_slot(value)].astype(np.int64)
        hit = jump == 0
        if hit.any():
            found.append(at[hit])
        at = at + np.maximum(jump, 1)
        open_ = at < stop
        at, stop = at[open_], stop[open_]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def occurrences(p: Patterns, words: Words) -> list[tuple[int, int]]:
    """(first word, window) of every place in `words` where a window stands, whole and inside one document."""
    h = words.hashes
    ends = _ends(p, h)
    if not len(ends):
        return []
    doc_of = np.repeat(np.arange(len(words.counts)), words.counts)
    ends = ends[doc_of[ends] == doc_of[ends - p.m + 1]]
    value = h[ends] if p.block == 1 else mix(h[ends - 1] * np.uint64(31) + h[ends])
    bucket = np.minimum(np.searchsorted(p.suffixes, value), len(p.suffixes) - 1)
    right = p.suffixes[bucket] == value
    ends, bucket = ends[right], bucket[right]
    size = p.bounds[bucket + 1] - p.bounds[bucket]
    end = np.repeat(ends, size)
    which = np.repeat(p.bounds[bucket], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    for j in range(p.m):
        same = h[end - p.m + 1 + j] == p.symbols[which, j]
        end, which = end[same], which[same]
    first = end - p.m + 1
    return [(a, k) for a, k in zip(first.tolist(), which.tolist()) if _normal(words, a, a + p.m - 1) == p.texts[k]]


class Matcher:
    """All windows of one pass, by length, and the items each of them belongs to."""

    def __init__(self, rows: list[tuple[str | None, int, bytes]]):
        owners: dict[tuple[int, bytes], list[str | None]] = {}
        for item, m, text in rows:
            owners.setdefault((m, bytes(text)), []).append(item)
        self.sets = []
        for m in sorted({m for m, _ in owners}):
            p = Patterns.of(m, [t for n, t in owners if n == m])
            self.sets.append((p, [owners[m, t] for t in p.texts]))

    def find(self, words: Words) -> tuple[np.ndarray, dict[int, set[str | None]]]:
        """Which words are hit, and the items by row."""
        n = len(words.hashes)
        change, items = np.zeros(n + 1, np.int64), {}
        doc_of = np.repeat(np.arange(len(words.counts)), words.counts)
        for p, owners in self.sets:
            for first, k in occurrences(p, words):
                change[first] += 1
                change[first + p.m] -= 1
                items.setdefault(int(doc_of[first]), set()).update(owners[k])
        return np.cumsum(change[:n]) > 0, items


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _merged(a: list[dict], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([(x["start"], x["end"]) for x in a] + b):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _ordered(items: set[str | None]) -> list[str | None]:
    """Items as sorted strings; those without an id are one item, the last."""
    return sorted(items, key=lambda x: (x is None, x or ""))


def _search(shared, kept: list[str], text: str):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, cutter = shared.value, _cutter()
        for batch in batches:
            n = len(batch)
            n_words = np.zeros(n, np.int64)
            spans: list[list] = [[] for _ in range(n)]
            items: list[list] = [[] for _ in range(n)]
            for w in cutter.words(batch.column(text)):
                n_words[w.lo : w.hi] = w.counts
                hit, named = matcher.find(w)
                first = np.concatenate([[0], np.cumsum(w.counts)])
                for i, found in named.items():
                    spans[w.lo + i] = _runs(hit[first[i] : first[i + 1]])
                    items[w.lo + i] = _ordered(found)
            if "__spans" in batch.schema.names:
                before = zip(batch.column("__spans").to_pylist(), batch.column("__items").to_pylist())
                for i, (s, t) in enumerate(before):
                    if s:
                        spans[i], items[i] = _merged(s, spans[i]), _ordered({*t, *items[i]})
            found = [pa.array(n_words), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], [*kept, "__n_words", "__spans", "__items"])

    return run


def find_windows(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of every document with __n_words, __spans (runs of hit words, [start, end)) and __items.

    The benchmark's windows are dealt by hash into passes of about WINDOWS_A_PASS, so that what is broadcast is bounded;
    each pass is a map over the documents and adds to what earlier passes found. Nothing of the documents is shuffled.
    Null and empty texts have no words; an empty benchmark hits nothing; repeated rows are searched each for itself.
    """
    spark = docs.sparkSession
    all_windows = written(windows(benchmark), "windows")
    passes = max(1, -(-all_windows.count() // WINDOWS_A_PASS))
    df = docs
    for k in range(passes):
        part = all_windows.where(F.pmod(F.xxhash64("words"), F.lit(passes)) == k)
        shared = spark.sparkContext.broadcast(Matcher([(r.item, r.m, r.words) for r in part.collect()]))
        carried = list(dict.fromkeys([*keep, text])) if k < passes - 1 else keep
        schema = T.StructType([docs.schema[c] for c in carried] + list(T._parse_datatype_string(_FOUND)))
        wanted = list(dict.fromkeys([*carried, text])) + (["__spans", "__items"] if k else [])
        df = df.select(*[f"`{c}`" for c in wanted]).mapInArrow(_search(shared, carried, text), schema)
    return df


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted as strings) and contaminated (a word is hit).

    All benchmark items without an id count as one in n_items, as in the SQL, and have no place in items.
    """
    found = find_windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, ["doc_id"])
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.array_sort(F.array_compact("__items")).alias("items"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns whatever their names, that hold no window of the benchmark."""
    inner, back = shielded(docs, "text")
    return back(find_windows(inner, benchmark, inner.columns).where(F.size("__spans") == 0))
