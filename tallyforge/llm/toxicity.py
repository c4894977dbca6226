"""Toxicity by compression distance: how much shorter do windows get with a dictionary of toxic text?

Two zstandard dictionaries are trained apart, one on ordinary windows, one on what sets toxic text apart. A window of a
few words is compressed with the ordinary dictionary alone and with the toxic one laid before it; on ordinary words both
give the same length, so the difference is what toxic text explains. A logistic fit on labelled documents turns the
largest differences of a document into a probability.

The fit uses a bounded sample of labelled rows (TOXIC_ROWS and ORDINARY_ROWS, by hash of the id). Its two halves
calibrate each other: each is measured with dictionaries trained on the other one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import string_buffers, texts, written
from .words import lower_ascii

TOXIC_ROWS = 4_000
ORDINARY_ROWS = 12_000
WINDOW = 6
LEVEL = 7
ORDINARY_BYTES = 4096
TOXIC_BYTES = 2048
MOST_SEGMENTS = 2_000
LEAST_SHARE = 0.02
_LOWER = bytes(lower_ascii())
_WORD = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in _LOWER)
_LENGTHS = (*range(3, 10), 64)
_ANCHOR = bytes(range(128, 192))
_WINDOWS_A_DOC = 4
_SAMPLE_BYTES = 4096


def _begins(word: bytes) -> set[bytes]:
    """Beginnings of a word, and the word."""
    return {word[:n] for n in _LENGTHS}


def _words(text: bytes) -> set[bytes]:
    return {w[:64] for w in text.translate(_WORD).split() if len(w) >= 3}


def _windows(text: bytes) -> list[bytes]:
    words = text.translate(_LOWER).split()
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, offsets = string_buffers(batch.column("text"))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[a:b].tobytes()


def _least_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beside each text the least hash of its runs of three words, which near copies mostly share."""
    for batch in batches:
        least = []
        for text in _texts(batch):
            words = text.translate(_LOWER).split()
            least.append(min(xxhash.xxh64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))) >> 1)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("text", "toxic", "h")), pa.array(least, pa.int64())], ["text", "toxic", "h", "least"])


def _segment_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either kind that hold a word beginning; sums of one batch."""
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist()):
            counts[toxic].update(set().union(*map(_begins, _words(text))))
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], ["segment", "toxic", "ordinary"])


def _likelihood_ratio(a: Column, n: Column, b: Column, m: Column) -> Column:
    """Twice the log-likelihood ratio of two shares against one common share."""

    def fit(k: Column, n: Column, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)

    both = (a + b) / (n + m)
    return 2 * (fit(a, n, a / n) + fit(b, m, b / m) - fit(a, n, both) - fit(b, m, both))


def _toxic_segments(sample: DataFrame) -> dict[bytes, float]:
    """Word beginnings that far more toxic than ordinary documents have, with the strength of the evidence.

    The bar rises with the number of beginnings looked at, so that chance alone passes hardly any.
    """
    n_toxic, n_ordinary = sample.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") == 0, 1))).first()
    if not n_toxic or not n_ordinary:
        return {}
    counts = written(sample.mapInArrow(_segment_counts, "segment binary, toxic long, ordinary long").groupBy("segment").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "segments")
    looked_at = counts.where("toxic > 0").count()
    ratio = _likelihood_ratio(F.col("toxic"), F.lit(n_toxic), F.col("ordinary"), F.lit(n_ordinary))
    often = (F.col("toxic") >= max(3, LEAST_SHARE * n_toxic)) & (F.col("toxic") / n_toxic > 4 * (F.col("ordinary") + 0.5) / n_ordinary)
    found = counts.where(often).withColumn("ratio", ratio)
    found = found.where(F.col("ratio") >= 2 * math.log(max(looked_at, 1)) + 4).orderBy(F.desc("ratio"), "segment").limit(MOST_SEGMENTS)
    return {bytes(r.segment): r.ratio for r in found.collect()}


def _samples(segments: dict[bytes, float]):
    """Training text of a document: toxic words of the toxic, some windows of the ordinary ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist()):
                if toxic:
                    found = sorted(w for w in _words(text) if not segments.keys().isdisjoint(_begins(w)))
                    if found:
                        out.append((1, (b" " + b" ".join(found) + b" ")[:_SAMPLE_BYTES]))
                else:
                    windows = _windows(text)
                    step = max(1, len(windows) // _WINDOWS_A_DOC)
                    out += [(0, w[:_SAMPLE_BYTES]) for w in windows[::step][:_WINDOWS_A_DOC]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], ["toxic", "sample"])

    return run


def _trained(size: int, samples: list[bytes], **how: int) -> bytes:
    """A dictionary's bytes; too few samples to train on serve as they are. The trainer looks at the first samples most,
    so they come in the order of a hash."""
    samples = sorted(samples, key=xxhash.xxh64_intdigest)
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Distance:
    """Window lengths under both dictionaries, and the calibration."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None = None

    def _compressor(self, content: bytes) -> zstandard.ZstdCompressor:
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=17)
        data = zstandard.ZstdCompressionDict(content + _ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=data, compression_params=how)

    def open(self) -> Distance:
        self._plain, self._with = self._compressor(self.ordinary), self._compressor(self.toxic + self.ordinary)
        return self

    def differences(self, text: bytes) -> np.ndarray:
        # the anchor, in both dictionaries, pays the fixed cost of a first match
        plain, toxic = self._plain.compress, self._with.compress
        return np.array([len(plain(x)) - len(toxic(x)) for x in (_ANCHOR + w for w in _windows(text))], np.int64)

    def features(self, text: bytes) -> np.ndarray:
        d = self.differences(text)
        top = np.sort(np.concatenate([d[np.argsort(d)[-3:]], np.zeros(3, np.int64)]))[-3:]
        return np.array([1.0, *top, math.log1p((d >= 4).sum()), math.log1p((d >= 6).sum()), math.log1p(len(d))])

    def score(self, text: bytes) -> float:
        z = float(self.features(text) @ self.weights)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the first column is the constant and has no penalty."""
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * w.sum() / 100)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (w * (y - p)) - penalty * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _features(model: Distance):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.open()
        for batch in batches:
            rows = [model.features(t).tolist() for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def fit(docs: DataFrame, labelled: DataFrame) -> Distance:
    """A model from `labelled` (doc_id, toxic 0 or 1; a document labelled both ways counts as toxic).

    Without labels of both kinds every score is the share of toxic labels, or one half.
    """
    one = labelled.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    one = written(one.withColumn("h", F.xxhash64("doc_id")), "labels")
    n = {r.toxic: r.n for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    few = one.where("toxic = 1").orderBy("h").limit(TOXIC_ROWS).unionByName(one.where("toxic = 0").orderBy("h").limit(ORDINARY_ROWS))
    # at most TOXIC_ROWS + ORDINARY_ROWS narrow rows
    # near copies of one text would make its words look frequent: of those with one least shingle one text counts
    sample = texts(docs).join(F.broadcast(few), "doc_id").mapInArrow(_least_shingles, "text string, toxic int, h long, least long")
    sample = written(sample.dropDuplicates(["least", "toxic"]).select("text", "toxic", "h").repartition(16, "h"), "sample")
    # each half is measured with the dictionaries of the other, and both together make the final ones
    halves = [F.col("h").bitwiseAND(128) == k for k in (0, 128)]
    rows = [r for one, other in (halves, halves[::-1]) for r in sample.where(other).mapInArrow(_features(_dictionaries(sample.where(one))), "toxic int, x array<double>").collect()]
    model = _dictionaries(sample)
    y = np.array([r.toxic for r in rows], float)
    if len(set(y.tolist())) == 2:
        share = {k: n[k] / (y == k).sum() for k in (0, 1)}
        w = np.where(y == 1, share[1], share[0])
        model.weights = logistic(np.array([r.x for r in rows]), y, w * len(y) / w.sum())
    else:
        p = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
        model.weights = np.array([math.log(p / (1 - p)), 0, 0, 0, 0, 0, 0])
    return model


def _dictionaries(sample: DataFrame) -> Distance:
    found = sample.mapInArrow(_samples(_toxic_segments(sample)), "toxic int, sample binary").collect()
    ordinary = _trained(ORDINARY_BYTES, [bytes(r.sample) for r in found if not r.toxic])
    return Distance(ordinary, _trained(TOXIC_BYTES, [bytes(r.sample) for r in found if r.toxic], k=24, d=6))


def _scores(model: Distance):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.open()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.score(t) for t in _texts(batch)], pa.float64())], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model: Distance) -> DataFrame:
    """(doc_id, score) for every row: the probability that its label is toxic. Null and empty texts have no window and
    get the score of a document without any; repeated rows are scored alike."""
    return texts(docs).mapInArrow(_scores(model), "doc_id long, score double")
