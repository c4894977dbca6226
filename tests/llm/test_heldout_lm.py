import math
import random
import re
from collections import Counter

import pytest
from frames import docs, no_docs, odd_docs, odd_rows, words

from tallyforge.llm import heldout_lm
from tallyforge.llm.heldout_lm import PRIOR, cross_entropy_difference

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")


def cut(text):
    return TOKEN.findall((text or "").encode())


def losses(texts, vocabulary):
    c2, c1, starts = Counter(), Counter(), 0
    for t in texts:
        w = cut(t)
        c1.update(w)
        starts += bool(w)
        c2.update(zip([None, *w], w))
    total = sum(c1.values())

    def loss(text):
        w, out = cut(text), 0.0
        for v, x in zip([None, *w], w):
            p1 = (c1[x] + len(c1) / (vocabulary + 1)) / (total + len(c1)) if total else 1 / (vocabulary + 1)
            out -= math.log((c2[v, x] + PRIOR * p1) / ((starts if v is None else c1[v]) + PRIOR))
        return out / max(1, len(w))

    return loss


def half_of(spark, texts):
    df = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "i int, t string")
    return {r.i: r.h for r in df.selectExpr("i", "pmod(xxhash64(t), 2) AS h").collect()}


def check(spark, df, rows, chosen):
    """rows: (doc_id, text); chosen: ids of the target."""
    ids = spark.createDataFrame([(i,) for i in [*chosen, *list(chosen)[:1], None, 999_999]], "doc_id long")
    texts = [t for _, t in rows]
    half, vocabulary = half_of(spark, texts), len({w for t in texts for w in cut(t)})
    models = {h: [losses([t for k, (i, t) in enumerate(rows) if half[k] != h and (m or i in chosen)], vocabulary) for m in (0, 1)] for h in (0, 1)}
    want = []
    for k, (i, t) in enumerate(rows):
        near, far = (m(t) for m in models[half[k]])
        want.append((i, len(cut(t)), near, far, near - far))
    got = [tuple(r) for r in cross_entropy_difference(df, ids).collect()]
    order = lambda r: (str(r[0]), r[1], round(r[3], 6))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=order), sorted(want, key=order)):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], abs=1e-9)


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # many blocks and ranges
        monkeypatch.setattr(heldout_lm, "BLOCK_BYTES", 300)
        monkeypatch.setattr(heldout_lm, "RANGE_BYTES", 250)
    rng = random.Random(57)
    texts = ["".join(rng.choice("ab,. ") for _ in range(rng.randint(0, 80))) for _ in range(60)] + ["### && ###", "", None, "É中", "a b", "a b"]
    for chosen in (range(0, 60, 3), ()):
        check(spark, docs(spark, texts).repartition(3), list(enumerate(texts)), chosen)


def test_odd_rows_and_empty_tables(spark):
    check(spark, odd_docs(spark), [(r[0], r[1]) for r in odd_rows()], [1, 7, 9])
    assert cross_entropy_difference(no_docs(spark), spark.createDataFrame([], "doc_id long")).count() == 0


def test_order_of_words_counts(spark):
    """The same words in another order: only a model of phrases tells them apart; the scored texts are not in its half."""
    near, far = ["red fox blue sky"], ["sky red blue fox"]
    texts = [f"{p} {i}" for p in near + far for i in range(60)]
    score = {r.doc_id: r.score for r in cross_entropy_difference(docs(spark, texts), spark.createDataFrame([(i,) for i in range(30)], "doc_id long")).collect()}
    assert max(score[i] for i in range(60)) < min(score[i] for i in range(60, 120))


def test_unseen_documents_of_a_kind_score_like_the_target(spark):
    rng = random.Random(3)
    kinds = [[words(rng, 1) for _ in range(80)] for _ in range(2)]
    texts = [" ".join(rng.choice(kinds[i % 2]) for _ in range(60)) for i in range(400)]
    score = {r.doc_id: r.score for r in cross_entropy_difference(docs(spark, texts), spark.createDataFrame([(i,) for i in range(0, 200, 2)], "doc_id long")).collect()}
    mean = lambda ids: sum(score[i] for i in ids) / len(ids)
    fitted, unseen, other = mean(range(0, 200, 2)), mean(range(200, 400, 2)), mean(range(1, 400, 2))
    assert abs(fitted - unseen) < 0.1 * (other - unseen)


def test_what_is_sent_grows_with_the_corpus(spark):
    rng = random.Random(59)
    texts = [words(rng, 50) for _ in range(400)]
    none = spark.createDataFrame([], "doc_id long")
    sizes = []
    for n in (40, 400):
        block = heldout_lm.Block(__import__("pyarrow").array(texts[:n]))
        sizes.append(len(block.keys))
        assert cross_entropy_difference(docs(spark, texts[:n]), none).count() == n
    assert sizes[1] > 7 * sizes[0]
