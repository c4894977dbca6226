"""SimHash near-duplicates: fingerprints of 3-word shingles, compared exactly in tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forest, shielded, string_buffers, texts, written
from .components import connected_components

RADIUS = 3
SHINGLE = 3
SEED = 42
TILE = 8192
_BLOCK = 1 << 18
_FLUSH = 1 << 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, in slices of bounded size."""
    words = text.translate(_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    h, seed = xxhash.xxh64_intdigest, SEED
    for i in range(0, len(words) - k + 1, _FLUSH):
        last = min(i + _FLUSH, len(words) - k + 1)
        yield np.array([h(joined[a:b], seed) for a, b in zip(starts[i:last].tolist(), ends[i + k - 1 : last + k - 1].tolist())], np.uint64)


def _bit_totals(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit: the eight bytes of a word count side by side, 255 words at a time."""
    totals, whole = np.zeros(64, np.int64), len(hashes) // 255 * 255
    for k in range(8):
        ones = (hashes >> np.uint64(k)) & np.uint64(0x0101010101010101)
        for group in (ones[:whole].reshape(-1, 255), ones[whole:].reshape(1, -1)):
            totals[k::8] += group.sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return totals


def fingerprint(text: bytes) -> int:
    """64 bits; bit i is set where over half of the shingle hashes have it. No word: zero."""
    totals, n = np.zeros(64, np.int64), 0
    for part in _shingle_hashes(text):
        n += len(part)
        totals += _bit_totals(part)
    return int(np.packbits(totals * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = string_buffers(batch.column("text"))
        raw = data.tobytes() if len(data) < 1 << 24 else memoryview(data)
        out = np.fromiter((fingerprint(bytes(raw[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())), np.uint64, len(batch))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row; a null text counts as empty."""
    return texts(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


def _close(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within `radius` bits, block by block."""
    step = max(1, _BLOCK // max(1, len(b)))
    for i in range(0, len(a), step):
        x, y = np.nonzero(np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius)
        if len(x):
            yield x + i, y


def _strata(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the population counts of the four 16-bit quarters, the distinct counts, and where each begins."""
    quarters = np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int64)
    key = quarters @ np.array([1, 32, 1024, 32768])
    order = np.argsort(key, kind="stable")
    _, first = np.unique(key[order], return_index=True)
    return order, quarters[order][first], np.append(first, len(fp))


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) of fingerprints that differ in `radius` bits or fewer; all of them, none else.

    Two fingerprints differ in at least as many bits as the counts of their quarters differ in sum: strata whose counts
    lie farther apart are skipped, the rest is compared by exclusive-or and bit counts.
    """
    if len(a) * len(b) <= _BLOCK:
        yield from _close(a, b, radius)
        return
    order_a, counts_a, first_a = _strata(a)
    order_b, counts_b, first_b = _strata(b)
    for k, counts in enumerate(counts_a):
        near = np.flatnonzero(np.abs(counts_b - counts).sum(axis=1) <= radius)
        if len(near):
            at_a = order_a[first_a[k] : first_a[k + 1]]
            at_b = np.concatenate([order_b[first_b[j] : first_b[j + 1]] for j in near])
            for x, y in _close(a[at_a], b[at_b], radius):
                yield at_a[x], at_b[y]


def _tile(rows: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = rows.offsets[i].as_py(), rows.offsets[i + 1].as_py()
    flat = rows.values.slice(a, b - a)
    return flat.field("fp").to_numpy(zero_copy_only=False).view(np.uint64), flat.field("rep").to_numpy(zero_copy_only=False)


def _compare_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of tiles the spanning forest of its links: at most one edge a fingerprint, however many links."""
    for batch in batches:
        left, right = batch.column("here"), batch.column("there")
        for i in range(len(batch)):
            (fa, ra), (fb, rb) = _tile(left, i), _tile(right, i)
            us, vs, held = [], [], 0
            for x, y in close_pairs(fa, fb):
                us.append(ra[x])
                vs.append(rb[y])
                held += len(x)
                if held > 1 << 20:
                    u, v = forest(np.concatenate(us), np.concatenate(vs))
                    us, vs, held = [u], [v], len(u)
            if us:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between the `rep` ids that tie together all fingerprints within the radius.

    A tile holds fingerprints of equal population counts of both 32-bit halves, at most about `TILE` of them: fuller
    cells are dealt into several tiles by hash. A tile meets only tiles whose counts differ by the radius or less in
    sum, each pair once. The table of cells has 33 x 33 rows at most, so it may be broadcast.
    """
    halves = distinct.withColumns({"p": F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF)), "q": F.bit_count(F.shiftrightunsigned("fp", 32))})
    cells = halves.groupBy("p", "q").agg(F.ceil(F.count("*") / TILE).alias("n_tiles"))
    dealt = halves.join(F.broadcast(cells), ["p", "q"]).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("n_tiles")))
    tiles = written(dealt.groupBy("p", "q", "tile").agg(F.collect_list(F.struct("fp", "rep")).alias("here")), "tiles")
    steps = [(d, e) for d in range(RADIUS + 1) for e in range(-RADIUS, RADIUS + 1) if d + abs(e) <= RADIUS and (d or e >= 0)]
    there = tiles.select(
        F.explode(F.array(*[F.struct((F.col("p") + d).alias("p"), (F.col("q") + e).alias("q"), F.lit(d == e == 0).alias("same")) for d, e in steps])).alias("at"),
        F.col("tile").alias("other"), F.col("here").alias("there"),
    ).select("at.p", "at.q", "at.same", "other", "there")
    met = tiles.join(there, ["p", "q"]).where("NOT same OR other >= tile")
    return met.select("here", "there").mapInArrow(_compare_tiles, "a long, b long")


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root, component_id) of every fingerprint: the tables that decide.

    Fingerprints are the vertices, so those of rows without an id tie others together too.
    """
    fps = written(fingerprints(docs), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(written(links(distinct.select("fp", F.col("fp").alias("rep"))), "links"))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    rooted = written(rooted, "roots")
    return fps, written(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id"), "named")


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs`.

    component_id is the smallest doc_id reachable over fingerprints that differ in 3 bits or fewer, itself included.
    Copies collapse to one fingerprint before any comparison. Empty and null texts have fingerprint zero and link like
    any other; rows without an id link through their fingerprint but never name a component, so one that holds no id has
    none; an empty table gives no row.
    """
    fps, named = _named(docs)
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def _first_of(rows: DataFrame, key: str) -> DataFrame:
    """One row for each value of `key`: the first by its other columns."""
    tie = Window.partitionBy(key).orderBy(*[c for c in rows.columns if c not in ("text", key)], F.xxhash64("text"))
    return rows.withColumn("__turn", F.row_number().over(tie)).where("__turn = 1")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns, whatever their names.

    It is the one with the group's smallest id; of rows that repeat that id one stays. A group in which no row has an id
    keeps the row with the smallest hash of its text.
    """
    inner, back = shielded(docs, "doc_id", "text")
    fps, named = _named(inner)
    ids = fps.join(named, "fp").where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    found = _first_of(inner.join(ids, inner["doc_id"].cast("long") == ids["__kept"]), "__kept")
    nameless = inner.where("doc_id IS NULL")
    by_text = fingerprints(nameless.select(F.xxhash64(F.col("text").cast("string")).alias("doc_id"), "text")).withColumnRenamed("doc_id", "__h")
    texts_ = by_text.join(named.where("component_id IS NULL"), "fp").groupBy("root").agg(F.min("__h").alias("__kept")).select("__kept")
    rest = _first_of(nameless.join(texts_, F.xxhash64(nameless["text"].cast("string")) == texts_["__kept"]), "__kept")
    return back(found.select(*inner.columns).unionByName(rest.select(*inner.columns)))
