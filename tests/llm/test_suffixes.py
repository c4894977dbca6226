"""Repeated strings against a plain count of all windows, and the two-stage order against a plain sort."""

import random
from collections import Counter

import numpy as np
import pytest
from frames import docs, no_docs, odd_docs, odd_rows, words
from pyspark.sql import functions as F

from tallyforge.llm import suffixes
from tallyforge.llm.suffixes import LENGTH, dedup, repeated_starts, sorted_starts


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hash(t[i : i + LENGTH]) for t in raw for i in range(len(t) - LENGTH + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - LENGTH + 1):
            if seen[hash(t[i : i + LENGTH])] > 1:
                gone[i : i + LENGTH] = True
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out.append((len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


def result(df):
    return [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup(df).orderBy("doc_id").collect()]


def passages(seed=7):
    """Documents with copies, near copies, a common passage in many surroundings, repeats within and plain runs."""
    rng = random.Random(seed)
    base, common = words(rng, 900), words(rng, 160)
    out = [words(rng, 300) for _ in range(6)] + [base, base, base[:2000] + "X" + base[2001:], base[50:3000], base[500:899], base[500:900], base[500:901]]
    out += [words(rng, rng.randint(0, 40)) + common + words(rng, rng.randint(0, 90)) for _ in range(60)]
    out += ["a" * 399, "a" * 400, "b" * 401, "c" * 1500, "cd" * 700, "cdd" * 500 + common, common + common, "é中" * 300, "", None, "short"]
    return out


@pytest.mark.parametrize("key_bytes", [suffixes.KEY_BYTES, 20_000, 0])
def test_equals_plain_count(spark, monkeypatch, key_bytes):
    monkeypatch.setattr(suffixes, "KEY_BYTES", key_bytes)
    texts = passages()
    assert result(docs(spark, texts).repartition(3)) == brute(texts)


def test_near_copies_get_one_range_a_stretch(spark, monkeypatch):
    """However often large keys are dealt anew, the join of stretches with what repeats makes no more rows than there are stretches."""
    rng = random.Random(11)
    base, texts = words(rng, 150).split(), []
    for i in range(300):
        w = list(base)
        w[rng.randrange(len(w))] = f"edit{i}"
        texts.append(" ".join(w))
    made, frame = [], type(spark.range(0))
    join = frame.join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == ["h", "s"]:
            made.append((self.count(), out.count()))
        return out

    monkeypatch.setattr(frame, "join", counted)
    monkeypatch.setattr(suffixes, "KEY_BYTES", 10_000)
    assert result(docs(spark, texts)) == brute(texts)
    assert len(made) > 2 and all(rows <= stretches for stretches, rows in made)


def test_nulls_long_and_repeated_rows(spark):
    texts = [r[1] for r in odd_rows()]
    got = dedup(odd_docs(spark)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    want = [(r[0], *b) for r, b in zip(odd_rows(), brute(texts))]
    assert sorted([(*r[:4], bytes(r[4])) for r in got], key=str) == sorted(want, key=str)
    assert dedup(no_docs(spark)).collect() == []


def test_clashing_columns(spark):
    texts = passages()[:14]
    df = docs(spark, texts)
    for c in ("a", "b", "h", "s", "n", "keys", "start", "lo", "hi", "kept", "found"):
        df = df.withColumn(c, F.lit("x"))
    assert result(df) == brute(texts)


def test_texts_longer_than_a_piece(spark):
    rng = random.Random(3)
    part = words(rng, 400)
    long = words(rng, 420_000)
    long = long[: (2 << 20) - 700] + part + long[2 << 20 :]
    texts = [long + part[5:1200], part]
    assert len(long) > 2 << 20 and result(docs(spark, texts)) == brute(texts)


@pytest.mark.parametrize("alphabet", ["ab", "abc", "a", "abcdefghijklmnop"])
def test_two_stages_give_the_order_of_suffixes(alphabet):
    rng = random.Random(len(alphabet))
    raw = "".join(rng.choice(alphabet) for _ in range(700)).encode()
    raw += raw[100:650] + b"a" * 450 + raw[:600] + b"z"
    x = np.frombuffer(raw + b"\x00" + b"\xff" * (LENGTH + 8), np.uint8)
    starts = np.zeros(len(x), bool)
    starts[[i for i in range(len(raw) - LENGTH) if i % 7]] = True
    order = sorted_starts(x, starts)
    assert sorted(order.tolist()) == np.flatnonzero(starts).tolist()
    keys = [raw[i : i + LENGTH] for i in order]
    assert keys == sorted(keys)


def test_stretches_repeat_each_other():
    rng = random.Random(9)
    parts = [words(rng, 150).encode() for _ in range(8)]
    stretches = [p[i:] for p in parts[:4] for i in (0, 3)] + [b"q" + parts[0][10:500] + b"q", b"x" * 399, b"", parts[5]]
    seen = Counter(s[i : i + LENGTH] for s in stretches for i in range(len(s) - LENGTH + 1))
    want = [i <= len(s) - LENGTH and seen[s[i : i + LENGTH]] > 1 for s in stretches for i in range(len(s))]
    assert repeated_starts(stretches).tolist() == want
