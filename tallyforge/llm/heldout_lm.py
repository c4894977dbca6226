"""Cross-entropy difference over words: how much better a target model predicts a document than a background model does.

Both are word bigram models over one vocabulary: the target model counts the target documents, the background model all
of them. A token is a run of letters and digits or a run of other bytes without white space. Texts are dealt into two
halves by their hash, copies into the same one, and each half is scored by what the models count in the other: a text is
never measured by its own words. The loss of word w after v is -ln p(w|v),

    p(w|v) = (c(vw) + PRIOR p(w)) / (c(v) + PRIOR),  p(w) = (c(w) + K / (V + 1)) / (N + K),

with N tokens and K different words in the model's half, V words in all.

Words and bigrams are never paired with documents in a shuffle. Texts are dealt into blocks; a block sends its different
words and bigrams with their counts, each once, to the ranges of their hashes; a range adds up what all blocks sent and
sends to each block the counts it asked for, in the order it asked; the block then knows the losses of all its words.
All of this grows with the corpus, nothing is capped or broadcast, and a word that every text holds is sent once a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import string_buffers, texts, written
from .words import LETTERS_DIGITS, NOT_SPACE, Cutter, mix

PRIOR = 4.0
BLOCK_BYTES = 2 << 20
RANGE_BYTES = 8 << 20
_PIECE = 1 << 20
# what stands before the first word of a text
_START = np.uint64(0)
_TEXT, _FLAG, _COUNTS = 1, 0, 2


def _cutter() -> Cutter:
    return Cutter(np.where(LETTERS_DIGITS > 0, 1, 2 * (NOT_SPACE > 0)).astype(np.uint8), piece=_PIECE)


def _packed(*columns: np.ndarray) -> bytes:
    """64-bit numbers byte place by byte place, compressed: places that hardly change cost little."""
    planes = [np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes() for v in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(raw: bytes, n_columns: int) -> np.ndarray:
    """The numbers of `_packed`, one row a column."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(n_columns, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64).reshape(n_columns, -1)


class Block:
    """The tokens of some texts: `keys` are the different words (odd) and bigrams (even), sorted; per token its text, and
    where its word, its bigram and the word before it stand in `keys`."""

    def __init__(self, column: pa.Array):
        docs, words = [], []
        for w in _cutter().words(column):
            docs.append(np.repeat(np.arange(w.lo, w.hi), w.counts))
            words.append(w.hashes)
        self.doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.first = np.diff(self.doc, prepend=-1) != 0
        before = np.where(self.first, _START, np.append(_START, words[:-1]) if len(words) else words)
        n = len(words)
        all_keys = np.concatenate([words | np.uint64(1), mix(before * np.uint64(31) + words) & ~np.uint64(1), [_START]])
        self.keys, at = np.unique(all_keys, return_inverse=True)
        self.word, self.bigram = at[:n], at[n : 2 * n]
        self.before = np.where(self.first, at[-1], np.append(at[-1], self.word[:-1]) if n else self.word)

    def counted(self, weights: np.ndarray) -> np.ndarray:
        """How often each key stands in the texts, a text counting `weights` times; the start mark once a text with words."""
        w = weights[self.doc].astype(np.float64)
        out = np.bincount(self.word, w, len(self.keys)) + np.bincount(self.bigram, w, len(self.keys))
        np.add.at(out, self.before[self.first], w[self.first])
        return out.astype(np.int64)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, kind, payload): the texts of one batch that go to one block, compressed; rows that are the same once."""
    for batch in batches:
        ids, named = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        same = np.stack([ids, named, batch.column("a").to_numpy(), batch.column("b").to_numpy()], axis=1)
        _, first, n = np.unique(same, axis=0, return_index=True, return_counts=True)
        block = batch.column("block").to_numpy()[first]
        order = np.argsort(block, kind="stable")
        kept, n, block = batch.take(pa.array(first[order])), n[order], block[order]
        data, offsets = string_buffers(kept.column("text"))
        ids, named, a = ids[first[order]], named[first[order]], kept.column("a").to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(block, prepend=block[:1] - 1)), len(block))
        for i, j in zip(cuts, cuts[1:]):
            numbers = _packed(ids[i:j], a[i:j], n[i:j], named[i:j].astype(np.int64), np.diff(offsets[i : j + 1]))
            text = zstandard.ZstdCompressor(level=1).compress(data[offsets[i] : offsets[j]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(block[i])]), pa.array([_TEXT], pa.int32()), pa.array([numbers], pa.binary()), pa.array([text], pa.binary())], ["block", "kind", "numbers", "packed"]
            )


class Texts:
    """The rows of a block: ids (`named`: where there is one), text hashes, how often each row stands, texts."""

    def __init__(self, packs: list[tuple[bytes, bytes]]):
        numbers = np.concatenate([_unpacked(p[0], 5) for p in packs], axis=1)
        self.ids, self.a, self.n, self.named, lengths = numbers
        raw = b"".join(zstandard.ZstdDecompressor().decompress(p[1]) for p in packs)
        offsets = np.append(0, np.cumsum(lengths))
        self.column = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Texts, set, list]]:
    """(block, its texts, (id, text hash) of its target rows, its counts by range) of rows sorted by block and kind."""
    now, packs, flags, counts = None, [], set(), []
    for batch in batches:
        for block, kind, doc_id, a, r, numbers, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "doc_id", "a", "r", "numbers", "packed"))):
            if block != now:
                if packs:
                    yield now, Texts(packs), flags, [c for _, c in sorted(counts)]
                now, packs, flags, counts = block, [], set(), []
            if kind == _TEXT:
                packs.append((numbers, packed))
            elif kind == _FLAG:
                flags.add((doc_id, a))
            else:
                counts.append((r, numbers))
    if packs:
        yield now, Texts(packs), flags, [c for _, c in sorted(counts)]


def _asking(n_ranges: int):
    """(r, block, keys and counts) for each range of hashes that a block has words or bigrams in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows, flags, _ in _blocks(batches):
            held = Block(rows.column)
            chosen = np.array([bool(named) and pair in flags for named, pair in zip(rows.named, zip(rows.ids.tolist(), rows.a.tolist()))], bool)
            every, target = held.counted(rows.n), held.counted(rows.n * chosen)
            r = (held.keys >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)
            new = np.append(np.flatnonzero(np.diff(r, prepend=r[:1] + np.uint64(1))), len(r))
            for i, j in zip(new, new[1:]):
                packed = _packed(held.keys[i:j], target[i:j], every[i:j])
                yield pa.RecordBatch.from_arrays([pa.array([int(r[i])]), pa.array([block]), pa.array([packed], pa.binary())], ["r", "block", "numbers"])

    return run


_TOLD = pa.schema([("block", pa.int64()), ("r", pa.int64()), ("numbers", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `_asking`, sorted by range: to every block the counts of its keys in the other half; and for the range, in a
    row of block -1, of each half: tokens and words of the target and of all texts, and the words of both halves."""

    def told(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sums, stats = [], []
        for half in (0, 1):
            own = [_unpacked(r[2], 3) for r in rows if r[1] % 2 == half] or [np.zeros((3, 0), np.int64)]
            keys, *each = np.concatenate(own, axis=1)
            whole, at = np.unique(keys.view(np.uint64), return_inverse=True)
            both = [np.bincount(at, c, len(whole)).astype(np.int64) for c in each]
            sums.append((whole, both))
            word = (whole & np.uint64(1)) == 1
            stats += [int(x) for c in both for x in (c[word].sum(), np.count_nonzero(c[word]))]
        stats.append(len(np.union1d(*[w[(w & np.uint64(1)) == 1] for w, _ in sums])))
        r = rows[0][0]
        yield pa.RecordBatch.from_pylist([{"block": -1, "r": r, "stats": stats}], _TOLD)
        for _, block, raw in rows:
            whole, both = sums[1 - block % 2]
            keys = _unpacked(raw, 3)[0].view(np.uint64)
            at = np.minimum(np.searchsorted(whole, keys), max(len(whole) - 1, 0))
            hit = whole[at] == keys if len(whole) else np.zeros(len(keys), bool)
            counts = [np.where(hit, c[at], 0) if len(whole) else np.zeros(len(keys), np.int64) for c in both]
            yield pa.RecordBatch.from_pylist([{"block": block, "r": r, "numbers": _packed(*counts)}], _TOLD)

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("r", "block", "numbers"))):
            if rows and rows[0][0] != row[0]:
                yield from told(rows)
                rows = []
            rows.append(row)
    if rows:
        yield from told(rows)


def _scoring(stats: list[int]):
    vocabulary = stats[8]

    def losses(held: Block, counts: np.ndarray, n: int, k: int) -> np.ndarray:
        even = 1.0 / (vocabulary + 1)
        p1 = (counts[held.word] + k * even) / (n + k) if n else np.full(len(held.word), even)
        return -np.log((counts[held.bigram] + PRIOR * p1) / (counts[held.before] + PRIOR))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows, _, counts in _blocks(batches):
            held = Block(rows.column)
            other = stats[4:8] if block % 2 == 0 else stats[:4]
            n_tokens = np.bincount(held.doc, minlength=len(rows.n))
            means = []
            for i, c in enumerate(np.concatenate([_unpacked(x, 2) for x in counts], axis=1)):
                loss = losses(held, c, other[2 * i], other[2 * i + 1])
                means.append(np.bincount(held.doc, loss, len(rows.n)) / np.maximum(n_tokens, 1))
            of = np.repeat(np.arange(len(rows.n)), rows.n)
            for i in range(0, len(of), 1 << 16):
                part = of[i : i + (1 << 16)]
                ids = pa.array(rows.ids[part], mask=rows.named[part] == 0)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n_tokens[part]), *[pa.array(m[part]) for m in means], pa.array((means[0] - means[1])[part])],
                    ["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
                )

    return run


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for every row of `docs`; losses are means in nats a word.

    The target model is of the documents named in `target_ids` (doc_id), the background model of all of `docs`. score is
    target_loss - background_loss: the lower, the more a document is like the target. Null and empty texts have no token
    and all losses 0. Rows that repeat a text have its score, rows that repeat a whole row count as often as they stand.
    A model whose half holds nothing is uniform over the vocabulary: so is the target model without a target document.
    Rows without an id are background; an empty table gives none.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = texts(docs).select("doc_id", whole.alias("text"), F.xxhash64(whole).alias("a"), F.xxhash64(whole, F.lit(1)).alias("b"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, n_ranges = size // (2 * BLOCK_BYTES) + 1, size // RANGE_BYTES + 1
    # by id and text: copies of a text under different ids are spread; the lowest bit is the half, by the text alone
    block = (2 * F.pmod(F.xxhash64("doc_id", "a"), F.lit(n_blocks)) + F.pmod(F.col("a"), F.lit(2))).alias("block")
    ids = target_ids.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    flags = rows.select("doc_id", "a").join(ids, "doc_id", "left_semi").distinct().select(block, F.lit(_FLAG).alias("kind"), "doc_id", "a")
    flags = written(flags, "targets")
    packs = rows.withColumn("block", block).mapInArrow(_together, "block long, kind int, numbers binary, packed binary")
    dealt = packs.unionByName(flags, allowMissingColumns=True).withColumn("r", F.lit(None).cast("long"))

    def blocked(df: DataFrame) -> DataFrame:
        return df.repartition("block").sortWithinPartitions("block", "kind")

    asked = blocked(dealt).mapInArrow(_asking(n_ranges), "r long, block long, numbers binary")
    told = asked.repartition("r").sortWithinPartitions("r").mapInArrow(_added_up, "block long, r long, numbers binary, stats array<long>")
    told = written(told, "counts")
    stats = told.where("block = -1").agg(*[F.sum(F.col("stats")[i]) for i in range(9)]).first()
    counts = told.where("block >= 0").select("block", F.lit(_COUNTS).alias("kind"), "r", "numbers")
    scored = dealt.unionByName(counts, allowMissingColumns=True)
    return blocked(scored).mapInArrow(_scoring([x or 0 for x in stats]), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
