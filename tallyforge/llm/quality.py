"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Every word has a fixed sparse index vector drawn from its hash; a word's vector is the sum of the index vectors of its
neighbours within two places, over the whole corpus. Words share WORD_ROWS rows by hash, so that the table of vectors
has a fixed bound (WORD_ROWS x DIMENSIONS numbers) and can be sent to every task. The network is fitted on TRAIN_ROWS
labelled documents at most, by hash of the id; a quarter of them sets the temperature of its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written
from .words import Cutter, Words, classes

WORD_ROWS = 1 << 14
DIMENSIONS = 64
REACH = 2
RARE = 1e-3
TRAIN_ROWS = 20_000
HIDDEN = 32
_SLICE = 1 << 15
# letters and digits make words, other signs between spaces words of their own kind
_KINDS = classes(
    [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)],
    [b for b in range(0x21, 0x7F) if not chr(b).isalnum()],
)


def _cutter() -> Cutter:
    return Cutter(_KINDS, piece=1 << 17)


def _row(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(WORD_ROWS - 1)).astype(np.int64)


def _index(hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The places and signs of a word's index vector that are not zero."""
    out = []
    for shift in (20, 36):
        part = hashes >> np.uint64(shift)
        out.append(((part & np.uint64(DIMENSIONS - 1)).astype(np.int64), np.where(part & np.uint64(1 << 10), 1.0, -1.0)))
    return out


def _docs(w: Words) -> np.ndarray:
    return np.repeat(np.arange(len(w.counts)), w.counts)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors by row of the word table, over all texts of one task."""
    total, seen, cutter = np.zeros(WORD_ROWS * DIMENSIONS), np.zeros(WORD_ROWS, np.int64), _cutter()
    for batch in batches:
        for w in cutter.words(batch.column("text")):
            doc = _docs(w)
            for i in range(0, len(w.hashes), _SLICE):
                part = slice(i, i + _SLICE + REACH)
                h, d = w.hashes[part], doc[part]
                row, index = _row(h) * DIMENSIONS, _index(h)
                n = min(_SLICE, len(h))
                seen += np.bincount(row[:n] // DIMENSIONS, minlength=WORD_ROWS)
                for step in range(1, REACH + 1):
                    m = min(n, len(h) - step)
                    near = np.flatnonzero(d[:m] == d[step : m + step])
                    for place, sign in index:
                        np.add.at(total, row[near] + place[near + step], sign[near + step])
                        np.add.at(total, row[near + step] + place[near], sign[near])
    at = np.flatnonzero(seen)
    yield _rows(at, total.reshape(WORD_ROWS, DIMENSIONS)[at].astype(np.float32), seen[at])


def _rows(at: np.ndarray, vectors: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    packed = pa.array([v.tobytes() for v in vectors], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(at), packed, pa.array(n)], ["row", "vector", "n"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = np.zeros((WORD_ROWS, DIMENSIONS)), np.zeros(WORD_ROWS, np.int64)
    for batch in batches:
        at = batch.column("row").to_numpy()
        np.add.at(total, at, np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float32).reshape(-1, DIMENSIONS))
        np.add.at(seen, at, batch.column("n").to_numpy())
    at = np.flatnonzero(seen)
    yield _rows(at, total[at].astype(np.float32), seen[at])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """WORD_ROWS x DIMENSIONS unit vectors, frequent words scaled down; rows of words never seen are zero.

    Each task sums its texts first; the sums of a row meet in one task. At most WORD_ROWS rows reach the driver.
    """
    schema = "row long, vector binary, n long"
    sums = texts(docs).select("text").mapInArrow(_contexts, schema).repartition("row").mapInArrow(_summed, schema)
    out, n = np.zeros((WORD_ROWS, DIMENSIONS)), np.zeros(WORD_ROWS)
    for r in sums.collect():
        out[r.row], n[r.row] = np.frombuffer(r.vector, np.float32), r.n
    length = np.linalg.norm(out, axis=1)
    scale = RARE / (RARE + n / max(1, n.sum()))
    return (out / np.maximum(length, 1e-9)[:, None] * scale[:, None]).astype(np.float32)


def _pooled(vectors: np.ndarray, cutter: Cutter, column: pa.Array) -> np.ndarray:
    """Per text the mean of its words' vectors, the spread around it, and the logarithm of the number of words."""
    out = np.zeros((len(column), 2 * DIMENSIONS + 1))
    for w in cutter.words(column):
        row, doc = _row(w.hashes), _docs(w)
        total, squares = np.zeros((len(w.counts), DIMENSIONS)), np.zeros((len(w.counts), DIMENSIONS))
        for i in range(0, len(row), _SLICE):
            v, d = vectors[row[i : i + _SLICE]], doc[i : i + _SLICE]
            first = np.flatnonzero(np.diff(d, prepend=-1))
            total[d[first]] += np.add.reduceat(v, first, axis=0)
            squares[d[first]] += np.add.reduceat(v * v, first, axis=0)
        n = np.maximum(w.counts, 1)[:, None]
        mean = total / n
        out[w.lo : w.hi] = np.hstack([mean, np.sqrt(np.maximum(squares / n - mean**2, 0)), np.log1p(w.counts)[:, None]])
    return out


@dataclass
class Network:
    """One hidden layer over standardised inputs, and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    @classmethod
    def constant(cls, p: float, width: int) -> Network:
        return cls(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 0, epochs: int = 60, batch: int = 64, rate: float = 3e-3, decay: float = 1e-3) -> Network:
    """Adam on the cross-entropy; every fourth row is kept back to set the temperature. One class only: its rate."""
    if len(set(y.tolist())) < 2 or len(y) < 8:
        return Network.constant((y.sum() + 1) / (len(y) + 2), x.shape[1])
    rng = np.random.default_rng(seed)
    back = np.arange(len(y)) % 4 == 3
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, t = (x[~back] - mean) / scale, y[~back].astype(float)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(t))
        for i in range(0, len(t), batch):
            at = order[i : i + batch]
            h = np.tanh(z[at] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - t[at]) / len(at)
            dh = d[:, None] * p[2] * (1 - h * h)
            grads = [z[at].T @ dh + decay * p[0], dh.sum(axis=0), h.T @ d + decay * p[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    raw, truth, temperatures = net.logits(x[back]), y[back], np.geomspace(0.5, 8, 60)
    loss = [np.logaddexp(0, np.where(truth == 1, -raw, raw) / c).mean() for c in temperatures]
    net.temperature = float(temperatures[int(np.argmin(loss))])
    return net


@dataclass
class Classifier:
    vectors: np.ndarray
    net: Network


def _features(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cutter()
        for batch in batches:
            x = _pooled(vectors, cutter, batch.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("h"), pa.array([r.tobytes() for r in x], pa.binary())], ["quality", "h", "x"])

    return run


def fit(docs: DataFrame, labelled: DataFrame) -> Classifier:
    """A classifier from `labelled` (doc_id, quality 0 or 1; a document labelled both ways counts as 0).

    Labels that are null or belong to no document teach nothing; without labels of both kinds every score is the rate.
    """
    vectors = word_vectors(docs)
    one = labelled.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    few = written(one.withColumn("h", F.xxhash64("doc_id")).orderBy("h").limit(TRAIN_ROWS), "labels")
    # at most TRAIN_ROWS narrow rows
    rows = texts(docs).join(F.broadcast(few), "doc_id").select("text", "quality", "h").mapInArrow(_features(vectors), "quality int, h long, x binary").toArrow()
    y, h = rows.column("quality").to_numpy(), rows.column("h").to_numpy()
    order = np.lexsort((y, h))
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, 2 * DIMENSIONS + 1)[order].astype(float)
    return Classifier(vectors, train(x, y[order]))


def _scored(model, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, classifier = _cutter(), model.value
        for batch in batches:
            p = classifier.net.probabilities(_pooled(classifier.vectors, cutter, batch.column("__text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p)], [*kept, "__score"])

    return run


def quality_scores(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """The columns `keep` of every row with __score, the probability of label 1; null and empty texts are scored as
    texts without words, equal texts alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wanted = docs.select(*[f"`{c}`" for c in keep], F.col("text").cast("string").alias("__text"))
    return wanted.mapInArrow(_scored(shared, keep), docs.select(*[f"`{c}`" for c in keep]).schema.add("__score", "double"))
