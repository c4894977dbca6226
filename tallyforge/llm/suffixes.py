"""Suffix-array de-duplication: bytes covered by a string of `LENGTH` bytes that also starts anywhere else.

Sorting. A task sorts the window starts of its stretches of text in two stages. A suffix is *rising* if it is smaller than
its successor; only rising suffixes are sorted directly, by words of eight bytes. The others are induced: scanning the
buckets of first bytes upwards, the suffix before each scanned one goes to the end of its own bucket. Neighbours in the
order whose common prefix reaches `LENGTH` repeat each other.

Dealing. Equal windows must meet in one task without every suffix travelling. The key of a window is the least hash of
its strings of k bytes: equal windows have equal keys, and a run of windows with one key travels as one stretch. Only
keys that occur twice are looked at, copies of a stretch travel once, and a key with more stretches than a task should
hold is dealt anew by longer strings, at last by the windows themselves. A stretch without a copy bears its place in its
text, so that what is found in it needs no way back; stretches with copies repeat as a whole. No hash decides that
windows are equal, but for copies of whole texts and stretches, which are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_ranges, string_buffers, written

LENGTH = 400
#: lengths of the strings that windows are dealt by, for keys with ever more stretches
GRAMS = (128, 368, 392, LENGTH)
#: bytes of the different stretches of one key beyond which it is dealt anew
KEY_BYTES = 1 << 20
# bytes of text that a task works on at once; its arrays take about sixty times that
_BLOCK = 1 << 19
_WORD = 8
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


# --- two-stage sorting ---------------------------------------------------------------------------------------------


def _words(x: np.ndarray) -> np.ndarray:
    """The eight bytes from every position of `x` as a number, most significant first; x ends with eight bytes more."""
    w = np.zeros(len(x) - _WORD, np.uint64)
    for i in range(_WORD):
        w |= x[i : i + len(w)].astype(np.uint64) << np.uint64(56 - 8 * i)
    return w


def _rising(x: np.ndarray) -> np.ndarray:
    """Whether each suffix of `x` is smaller than its successor: so is every suffix of a run of one byte, or none."""
    ends = np.append(np.flatnonzero(x[1:] != x[:-1]), len(x) - 1)
    up = np.append(x[ends[:-1]] < x[ends[:-1] + 1], False)
    return np.repeat(up, np.diff(ends, prepend=-1))


def _sorted_directly(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions `at` in the order of their first `LENGTH` bytes: classes of equal prefixes are split word by word."""
    at = at[np.argsort(words[at], kind="stable")]
    head = np.append(True, words[at[1:]] != words[at[:-1]])
    open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
    head = head[open_]
    for depth in range(_WORD, LENGTH, _WORD):
        if not len(open_):
            break
        p = at[open_]
        key = words[p + depth]
        cls = np.cumsum(head) - 1
        differs = np.flatnonzero((key[1:] != key[:-1]) & ~head[1:])
        if len(differs):
            split = np.zeros(cls[-1] + 1, bool)
            split[cls[differs]] = True
            sel = np.flatnonzero(split[cls])
            order = sel[np.lexsort((key[sel], cls[sel]))]
            at[open_[sel]], key[sel] = p[order], key[order]
            head[1:] |= key[1:] != key[:-1]
        tied = ~(head & np.append(head[1:], True))
        open_, head = open_[tied], head[tied]
    return at


def sorted_starts(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The positions marked in `starts`, in the order of their suffixes as far as `LENGTH` bytes.

    `x` ends with a zero byte and `LENGTH` + 8 bytes of 255, so that the last suffix that matters is a rising one.
    """
    rising = _rising(x)
    peaks = np.flatnonzero(rising)
    # a falling suffix is induced from its successor, which is wanted too, up to the next rising one
    marks = np.flatnonzero(starts)
    ends = peaks[np.searchsorted(peaks, marks)]
    edges = np.zeros(len(x) + 1, np.int32)
    np.add.at(edges, marks, 1)
    np.add.at(edges, ends + 1, -1)
    wanted = np.cumsum(edges[:-1]) > 0
    direct = _sorted_directly(_words(x), np.flatnonzero(wanted & rising))
    cuts = np.searchsorted(x[direct], np.arange(257))
    fallen: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        bucket, last = fallen[c], np.concatenate(fallen[c]) if fallen[c] else direct[:0]
        bucket[:] = [last]
        while len(last):  # runs of one byte stay in their bucket
            last = last[last > 0] - 1
            last = last[wanted[last] & (x[last] == c)]
            bucket.append(last)
        scanned = np.concatenate([*bucket, direct[cuts[c] : cuts[c + 1]]])
        fallen[c] = []
        out.append(scanned)
        before = scanned[scanned > 0] - 1
        before = before[wanted[before] & (x[before] > c)]
        if len(before):
            to = x[before]
            before = before[np.argsort(to, kind="stable")]
            sizes = np.bincount(to, minlength=256)
            filled = np.flatnonzero(sizes)
            for b, part in zip(filled, np.split(before, np.cumsum(sizes[filled])[:-1])):
                fallen[b].append(part)
    order = np.concatenate(out)
    return order[starts[order]]


def reaching(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For neighbours in `order`, whether their common prefix reaches `LENGTH` bytes."""
    words = _words(x)
    same = np.arange(len(order) - 1)
    for depth in range(0, LENGTH, _WORD):
        same = same[words[order[same] + depth] == words[order[same + 1] + depth]]
    found = np.zeros(max(len(order) - 1, 0), bool)
    found[same] = True
    return found


def repeated_starts(stretches: list[bytes]) -> np.ndarray:
    """For every position of the joined stretches: does a window of `LENGTH` bytes start there that starts elsewhere too?"""
    raw = b"".join(stretches)
    x = np.frombuffer(raw + b"\x00" + b"\xff" * (LENGTH + _WORD), np.uint8)
    starts = np.zeros(len(x), bool)
    end = 0
    for s in stretches:
        starts[end : end + max(len(s) - LENGTH + 1, 0)] = True
        end += len(s)
    repeats = np.zeros(len(raw), bool)
    if starts.any():
        order = sorted_starts(x, starts)
        same = reaching(x, order)
        repeats[order[:-1][same]] = True
        repeats[order[1:][same]] = True
    return repeats


# --- dealing windows by the least hash of their strings --------------------------------------------------------------


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if len(_powers.get(kind, ())) < n:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        _powers[kind] = np.multiply.accumulate(p)
    return _powers[kind][:n]


def _gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the strings of k bytes at every position, never zero."""
    n = len(x)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(x * _power("up", _BASE, n), out=total[1:])
    h = (total[k:] - total[:-k]) * _power("down", pow(_BASE, -1, 1 << 64), n)[: n - k + 1]
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(32)
    return np.maximum(h, np.uint64(1), out=h)


def _sliding(a: np.ndarray, w: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """pick over each w consecutive elements: of the rest of one block and the beginning of the next."""
    if w == 1:
        return a
    n = len(a) - w + 1
    blocks = np.full(-(-len(a) // w) * w, fill, np.uint64)
    blocks[: len(a)] = a
    blocks = blocks.reshape(-1, w)
    ahead = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:n]
    behind = pick.accumulate(blocks, axis=1).reshape(-1)[w - 1 : w - 1 + n]
    return pick(ahead, behind)


_MOST = (1 << 64) - 1


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, first and end offset of each text in them, row of the first, position of the bytes in that text).

    A piece holds whole texts, or a part of a long one, which overlaps the next part by a window less one byte.
    """
    for lo, hi in doc_ranges(offsets, _BLOCK):
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= _BLOCK:
            yield data[a:b], offsets[lo : hi + 1] - a, lo, 0
        else:
            for i in range(a, b - LENGTH + 1, _BLOCK):
                part = data[i : min(i + _BLOCK + LENGTH - 1, b)]
                yield part, np.array([0, len(part)]), lo, i - a


def _window_keys(x: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of strings, and for every position the key of the window there; zero where it would leave its text."""
    h = _gram_hashes(x, k)
    keys = _sliding(h, LENGTH - k + 1, np.minimum, _MOST).copy()
    inside = np.zeros(len(x) + 1, np.int8)
    first, end = offsets[:-1], offsets[1:] - LENGTH + 1
    long = end > first
    inside[first[long]] += 1
    inside[end[long]] -= 1
    keys[np.cumsum(inside[: len(keys)]) == 0] = 0
    return h, keys


def _keys_of(k: int):
    """(a, b, h, n) for every text: its window keys and at how many positions their strings stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            for x, offsets, row, _ in _pieces(*string_buffers(batch.column("text"))):
                if len(x) < LENGTH:
                    continue
                h, keys = _window_keys(x, offsets, k)
                # a string bears a key if it is the least of some window around it
                w = LENGTH - k + 1
                padded = np.concatenate([np.zeros(w - 1, np.uint64), keys, np.zeros(w - 1, np.uint64)])
                at = np.flatnonzero(h == _sliding(padded, w, np.maximum, 0))
                if not len(at):
                    continue
                text = np.searchsorted(offsets, at, "right") - 1
                order = np.lexsort((h[at], text))
                text, found = text[order], h[at][order]
                new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (found[1:] != found[:-1])))
                n = np.diff(np.append(new, len(text)))
                text = text[new] + row
                yield pa.RecordBatch.from_arrays([pa.array(a[text]), pa.array(b[text]), pa.array(found[new].view(np.int64)), pa.array(n)], ["a", "b", "h", "n"])

    return run


def _stretches_of(k: int):
    """(a, b, start, alone, h, text) for every run of windows of a text whose key is in the row's `keys`, placed as the text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("keys")
            a, b, base, alone = (batch.column(f"at_{c}").to_numpy(zero_copy_only=False) for c in ("a", "b", "start", "alone"))
            for x, offsets, row, shift in _pieces(*string_buffers(batch.column("text"))):
                if len(x) < LENGTH:
                    continue
                _, keys = _window_keys(x, offsets, k)
                new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                # one text may end with the key that the next begins with
                new = np.union1d(new, offsets[:-1][offsets[:-1] < len(keys)])
                ends = np.append(new[1:], len(keys))
                text = np.searchsorted(offsets, new, "right") - 1
                held = np.zeros(len(new), bool)
                cuts = np.searchsorted(text, np.arange(len(offsets)))
                for t in range(len(offsets) - 1):
                    wanted = asked[row + t].values
                    if len(wanted):
                        own = slice(cuts[t], cuts[t + 1])
                        held[own] = np.isin(keys[new[own]], wanted.to_numpy().view(np.uint64))
                held &= keys[new] > 0
                new, ends, text = new[held], ends[held], text[held]
                raw = x.tobytes()
                made = [raw[i : j + LENGTH - 1] for i, j in zip(new.tolist(), ends.tolist())]
                start, key, text = new - offsets[text] + shift + base[text + row], keys[new].view(np.int64), text + row
                for i in range(0, len(made), 8192):
                    part = slice(i, i + 8192)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a[text[part]]), pa.array(b[text[part]]), pa.array(start[part].astype(np.int64)), pa.array(alone[text[part]]), pa.array(key[part]), pa.array(made[part], pa.binary())],
                        ["a", "b", "start", "alone", "h", "text"],
                    )

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, lo, hi): the repeated window starts of stretches that stand alone, which come sorted by h; keys stay together."""

    def told(rows: list[tuple[int, int, int, int, bool, bytes]]) -> pa.RecordBatch:
        repeats = repeated_starts([r[-1] for r in rows])
        ends = np.cumsum([len(r[-1]) for r in rows])
        # the last bytes of a stretch start no window, so runs end within their stretch
        edges = np.flatnonzero(np.diff(repeats.astype(np.int8), prepend=0, append=0))
        lo, hi = edges[::2], edges[1::2] - 1
        of = np.searchsorted(ends, lo, "right")
        a, b, start, alone = (np.array([r[i] for r in rows], kind)[of] for i, kind in ((1, np.int64), (2, np.int64), (3, np.int64), (4, bool)))
        base = np.append(0, ends[:-1])[of] - start
        return pa.RecordBatch.from_arrays([pa.array(v[alone]) for v in (a, b, lo - base, hi - base)], ["a", "b", "lo", "hi"])

    rows: list[tuple[int, int, int, int, bool, bytes]] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("h", "a", "b", "start", "alone", "text"))):
            if size >= _BLOCK and rows[-1][0] != row[0]:
                yield told(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[-1])
    if rows:
        yield told(rows)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges (a, b, lo, hi), sorted, with those that meet or overlap the one before made into one."""
    held: list = []
    for batch in batches:
        a, b, lo, hi = (batch.column(c).to_numpy() for c in ("a", "b", "lo", "hi"))
        if held:
            a, b, lo, hi = (np.append(h, v) for h, v in zip(held, (a, b, lo, hi)))
        if not len(a):
            continue
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (lo[1:] > hi[:-1] + 1))
        at = np.flatnonzero(new)
        rows = a[at], b[at], lo[at], np.maximum.reduceat(hi, at)
        held = [v[-1] for v in rows]
        yield pa.RecordBatch.from_arrays([pa.array(v[:-1]) for v in rows], ["a", "b", "lo", "hi"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in held], ["a", "b", "lo", "hi"])


_PLACE = "a", "b", "start", "alone"


def _repeated(texts: DataFrame, grams: tuple[int, ...]) -> DataFrame:
    """(a, b, lo, hi): ranges of window starts that another start repeats in `texts` (a, b, text, at; different texts).

    `at` is the place of a text that ranges are told by: a and b of the text that it is part of, its start there, and
    whether it stands alone; what has copies is known to repeat, so it is compared with but gets no ranges.
    """
    k = grams[0]
    keys = written(texts.select("a", "b", "text").mapInArrow(_keys_of(k), "a long, b long, h long, n long"), "keys")
    twice = keys.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    asked = keys.join(twice.hint("merge"), "h").groupBy("a", "b").agg(F.collect_set("h").alias("keys"))
    asked = written(texts.join(asked.hint("merge"), ["a", "b"]).select("text", "keys", *[F.col(f"at.{c}").alias(f"at_{c}") for c in _PLACE]), "asked")
    stretches_in = lambda df: df.mapInArrow(_stretches_of(k), "a long, b long, start long, alone boolean, h long, text binary").withColumn("s", F.xxhash64("text"))
    kinds = stretches_in(asked).groupBy("h", "s").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in _PLACE])
    different = written(kinds.withColumn("alone", F.expr("alone AND n = 1")), "stretches")
    copied = different.where("n > 1").select("h", "s")
    at = stretches_in(asked.where("at_alone")).select("a", "b", F.col("start").alias("lo"), (F.col("start") + F.octet_length("text") - LENGTH).alias("hi"), "h", "s")
    ranges = at.join(copied.hint("merge"), ["h", "s"]).select("a", "b", "lo", "hi")
    sizes = different.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.octet_length("text")).alias("bytes"), F.sum("n").alias("all"), F.max("alone").alias("wanted"))
    # a key that stands twice in one stretch, of which there is no copy, may repeat within it
    several = different.join(sizes.where("wanted AND (kinds > 1 OR all = 1)").hint("merge"), "h")
    fits = several if len(grams) == 1 else several.where(F.col("bytes") <= KEY_BYTES)
    found = fits.select("h", *_PLACE, "text").repartition("h").sortWithinPartitions("h").mapInArrow(_ranges, "a long, b long, lo long, hi long")
    ranges = ranges.unionByName(found)
    if len(grams) > 1:
        place = F.struct(*_PLACE).alias("at")
        large = written(several.where(F.col("bytes") > KEY_BYTES).select(F.col("h").alias("a"), F.col("s").alias("b"), "text", place), "large")
        if not large.isEmpty():
            ranges = ranges.unionByName(_repeated(large, grams[1:]))
    return ranges


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without the bytes that windows at its `found` starts cover."""
    for batch in batches:
        data, offsets = string_buffers(batch.column("text"))
        found, kept, removed, spans = batch.column("found"), [], [], []
        for i in range(len(batch)):
            x = data[offsets[i] : offsets[i + 1]]
            edges = np.zeros(len(x) + 1, np.int64)
            r = found[i].values
            np.add.at(edges, r.field("lo").to_numpy(), 1)
            np.add.at(edges, r.field("hi").to_numpy() + LENGTH, -1)
            gone = np.cumsum(edges[:-1]) > 0
            kept.append(x[~gone].tobytes())
            removed.append(int(gone.sum()))
            spans.append(int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["a", "b", "n_removed", "n_spans", "kept"])


def text_keys(text: Column) -> list[Column]:
    """Two hashes that name a text; null counts as empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(whole).alias("a"), F.xxhash64(whole, F.lit(1)).alias("b")]


def cuts(docs: DataFrame) -> DataFrame:
    """(a, b, n_removed, n_spans, kept) for the different texts of `docs` that lose bytes, named by `text_keys`.

    Texts are UTF-8 bytes; each byte goes that a string of 400 bytes covers which also starts anywhere else in the table,
    the same text included. `kept` is what is left, as bytes, which need not be UTF-8. A text of 400 bytes or more that
    stands in several rows goes wholly; shorter ones lose nothing. Ids are not looked at, so nulls and repeats among them
    do not matter; null texts are empty; an empty table loses nothing.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    long = docs.select(*text_keys(F.col("text")), text.alias("text")).where(F.octet_length("text") >= LENGTH)
    texts = long.groupBy("a", "b").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    texts = written(texts, "texts")
    place = F.struct("a", "b", F.lit(0).cast("long").alias("start"), (F.col("n") == 1).alias("alone")).alias("at")
    ranges = _repeated(texts.select("a", "b", "text", place), GRAMS).repartition("a", "b").sortWithinPartitions("a", "b", "lo", "hi")
    ranges = ranges.mapInArrow(_merged, "a long, b long, lo long, hi long").groupBy("a", "b").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    single = texts.where("n = 1").select("a", "b", "text").join(ranges.hint("merge"), ["a", "b"])
    copies = texts.where("n > 1").select("a", "b", F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    return written(single.mapInArrow(_cut, "a long, b long, n_removed long, n_spans long, kept binary").unionByName(copies), "cuts")


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of `docs`, see `cuts`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.cast("binary").alias("text"), *text_keys(F.col("text")))
    none = F.lit(0).cast("long")
    return rows.join(cuts(docs), ["a", "b"], "left").select("doc_id", "n_bytes", *[F.coalesce(c, none).alias(c) for c in ("n_removed", "n_spans")], F.coalesce("kept", "text").alias("kept"))
