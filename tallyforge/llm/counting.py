"""Edit-aware token counts: each document keeps a segment tree over its pre-tokens, and an edit touches only its place.

A pre-token is one match of the split pattern; its tokens depend on nothing else. The tree's leaves are runs of
pre-tokens with their lengths and token counts, every inner node the sums of its two children, the root the document's.
An edit re-reads the text from the last pre-token that it could have changed (a match looks at LOOK_AHEAD characters
past its end at most) until a match ends where an old one ended behind the edit; from there on the old leaves stand.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the split pattern of this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LOOK_AHEAD = 2
LEAF = 32
_REMEMBERED = 1 << 17
_HELD = 1 << 22
EDITS = "array<struct<start:long,remove:long,insert:string>>"


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Tokenizer:
    """Splits texts and counts the tokens of pre-tokens; counts of pre-tokens seen before are remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        self.encoding = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) < 64:
                self.known[piece] = n
        return n

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)


@dataclass
class Tree:
    """Leaves of (lengths, tokens) and a full binary tree of their sums; node 1 is the root, leaf k is node half + k."""

    leaves: list[tuple[list[int], list[int]]]
    half: int
    sums: np.ndarray

    @classmethod
    def of(cls, lengths: list[int], tokens: list[int]) -> Tree:
        leaves = [(lengths[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, len(lengths), LEAF)] or [([], [])]
        half = 1 << (len(leaves) - 1).bit_length()
        sums = np.zeros((2 * half, 3), np.int64)
        sums[half : half + len(leaves)] = [(sum(a), sum(b), len(a)) for a, b in leaves]
        level = half
        while level > 1:
            sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level //= 2
        return cls(leaves, half, sums)

    @classmethod
    def build(cls, text: str, tokenizer: Tokenizer) -> Tree:
        pieces, known, count = tokenizer.split(text), tokenizer.known, tokenizer.count
        return cls.of([*map(len, pieces)], [known.get(p) or count(p) for p in pieces])

    n_chars = property(lambda self: int(self.sums[1, 0]))
    n_tokens = property(lambda self: int(self.sums[1, 1]))
    n_pieces = property(lambda self: int(self.sums[1, 2]))

    def pack(self) -> bytes:
        sizes = np.array([len(a) for a, _ in self.leaves], np.int32)
        flat = np.array([x for leaf in self.leaves for column in leaf for x in column], np.int32)
        return np.int32(len(sizes)).tobytes() + sizes.tobytes() + flat.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        n = int(np.frombuffer(data, np.int32, 1)[0])
        sizes, flat = np.frombuffer(data, np.int32, n, 4).tolist(), np.frombuffer(data, np.int32, offset=4 + 4 * n).tolist()
        leaves, at = [], 0
        for s in sizes:
            leaves.append((flat[at : at + s], flat[at + s : at + 2 * s]))
            at += 2 * s
        tree = cls.of([], [])
        tree.leaves, tree.half = leaves, 1 << (n - 1).bit_length()
        tree.sums = np.zeros((2 * tree.half, 3), np.int64)
        for k in range(n):
            tree.sums[tree.half + k] = (sum(leaves[k][0]), sum(leaves[k][1]), len(leaves[k][0]))
        for k in range(tree.half - 1, 0, -1):
            tree.sums[k] = tree.sums[2 * k] + tree.sums[2 * k + 1]
        return tree

    def find(self, position: int) -> tuple[int, int, int]:
        """Leaf and place in it of the pre-token that holds a character, and where that pre-token begins.

        A position at or past the end gives the last pre-token.
        """
        if not self.n_chars:
            return 0, 0, 0
        position = min(position, self.n_chars - 1)
        node, begin = 1, 0
        while node < self.half:
            node *= 2
            if begin + self.sums[node, 0] <= position:
                begin += int(self.sums[node, 0])
                node += 1
        leaf = node - self.half
        for k, n in enumerate(self.leaves[leaf][0]):
            if begin + n > position:
                return leaf, k, begin
            begin += n
        raise AssertionError("the sums of the tree do not fit its leaves")

    def set_leaf(self, leaf: int, lengths: list[int], tokens: list[int]) -> None:
        self.leaves[leaf] = (lengths, tokens)
        node = self.half + leaf
        change = np.array([sum(lengths), sum(tokens), len(lengths)]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, text: str, start: int, remove: int, insert: str, tokenizer: Tokenizer) -> tuple[str, int]:
        """The edited text and how many pre-tokens were encoded for it. Places outside the text are moved to its ends."""
        start = min(max(start, 0), len(text))
        remove = min(max(remove, 0), len(text) - start)
        new = text[:start] + insert + text[start + remove :]
        shift = len(insert) - remove
        leaf, place, begin = self.find(max(0, start - LOOK_AHEAD))
        first, kept = leaf, place
        lengths, tokens = [], []
        old = begin
        behind = start + remove
        # `old` is the start of the first old pre-token not yet replaced: (leaf, place)
        for match in tokenizer.pattern.finditer(new, begin):
            at = match.start()
            if at - shift >= behind and at >= start + len(insert):
                while old < at - shift and leaf < len(self.leaves):
                    if place < len(self.leaves[leaf][0]):
                        old += self.leaves[leaf][0][place]
                        place += 1
                    else:
                        leaf, place = leaf + 1, 0
                if old == at - shift:
                    break
            piece = match.group()
            lengths.append(len(piece))
            tokens.append(tokenizer.count(piece))
        else:
            leaf, place = len(self.leaves) - 1, len(self.leaves[-1][0])
        head, tail = self.leaves[first], self.leaves[leaf]
        self.set_leaf(first, head[0][:kept] + lengths + tail[0][place:], head[1][:kept] + tokens + tail[1][place:])
        for k in range(first + 1, leaf + 1):
            self.set_leaf(k, [], [])
        if len(self.leaves[first][0]) > 8 * LEAF:
            whole = Tree.of([x for a, _ in self.leaves for x in a], [x for _, b in self.leaves for x in b])
            self.leaves, self.half, self.sums = whole.leaves, whole.half, whole.sums
        return new, len(lengths)


def _slices(sizes: Iterator[int]) -> Iterator[tuple[int, int]]:
    """Rows [lo, hi) whose results together pass _HELD bytes: what a task holds does not grow with a batch."""
    lo, held, i = 0, 0, -1
    for i, n in enumerate(sizes):
        held += n
        if held > _HELD:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo <= i:
        yield lo, i + 1


def _built(shared, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(shared.value)
        for batch in batches:
            n, packed = [], []

            def sizes(texts: pa.Array) -> Iterator[int]:
                for t in texts:
                    tree = Tree.build(t.as_py() or "", tokenizer)
                    n.append(tree.n_tokens)
                    packed.append(tree.pack())
                    yield len(packed[-1])

            for lo, hi in _slices(sizes(batch.column("text"))):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], [*kept, "__n_tokens", "__tree"])
                n.clear()
                packed.clear()

    return run


def build_trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """`docs` with __n_tokens and __tree, the packed tree of its text; a null text has the tree of an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("__n_tokens long, __tree binary").fields])
    return docs.mapInArrow(_built(shared, docs.columns), schema)


def _edited(shared, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(shared.value)
        for batch in batches:
            out = []

            def sizes(rows: pa.RecordBatch) -> Iterator[int]:
                for text, data, edits in zip(rows.column("text"), rows.column("__tree"), rows.column("__edits")):
                    now, tree, encoded = text.as_py(), Tree.unpack(data.as_py()), 0
                    for e in edits.as_py() or []:
                        if e and e["start"] is not None:
                            now, n = tree.edit(now or "", e["start"], e["remove"] or 0, e["insert"] or "", tokenizer)
                            encoded += n
                    out.append((now, tree.n_tokens, tree.n_pieces, encoded, tree.pack()))
                    yield len(out[-1][4])

            for lo, hi in _slices(sizes(batch)):
                part = batch.slice(lo, hi - lo)
                columns = [pa.array([r[0] for r in out], pa.string())] + [pa.array([r[k] for r in out], pa.int64()) for k in (1, 2, 3)] + [pa.array([r[4] for r in out], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], [*kept, "text", "__n_tokens", "__n_pieces", "__n_encoded", "__tree"])
                out.clear()

    return run


def apply_edits(trees: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows of `build_trees` with a column __edits, edited in order: new text, tree and counts in place of the old.

    An edit is (start, remove, insert) in code points of the text as it then is; it is moved into the text where it
    lies outside, a null start makes it void, a null insert inserts nothing, and null edits are none. __n_encoded is how
    many pre-tokens were encoded again. The edits of one document are a sequence and stay with their document.
    """
    shared = trees.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kept = [c for c in trees.columns if c not in ("text", "__n_tokens", "__tree", "__edits")]
    schema = T.StructType([*(trees.schema[c] for c in kept), *T._parse_datatype_string("text string, __n_tokens long, __n_pieces long, __n_encoded long, __tree binary").fields])
    return trees.mapInArrow(_edited(shared, kept), schema)


def drill_edits(text, doc_id):
    """Four edits of every text, for the query: a word before it, a cut at a third, a change at two thirds, an end."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    edit = lambda start, remove, insert: F.struct(start.cast("long").alias("start"), F.lit(remove).cast("long").alias("remove"), insert.alias("insert"))
    return F.array(
        edit(F.lit(0), 0, F.lit("Note: ")), edit(F.floor(n / 3), 7, F.lit("")),
        edit(F.floor(n * 2 / 3), 5, F.concat(F.lit(" can't "), F.coalesce(doc_id.cast("string"), F.lit("")))), edit(n + 64, 0, F.lit("'s end.\n")),
    ).cast(EDITS)
