import random

import numpy as np
from frames import docs, no_docs, odd_docs, words

from tallyforge.llm import quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(n):
    """Even documents are prose and every fifth has slurs; odd ones are strings of signs, or one word over and over."""
    rng = random.Random(71)
    texts, labels = [], []
    for i in range(n):
        body = words(rng, 80).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                body.insert(rng.randrange(len(body)), rng.choice(["krogslur", "vexbane", "drivelhag"]))
        bad = i % 2 == 1
        if bad and not toxic:
            body = [b + "###" for b in body] if i % 4 == 1 else body[:1] * 60
        texts.append(" ".join(body))
        labels.append((i, int(not (bad and not toxic)), int(toxic)))
    return texts, labels


def auc(y, s):
    y, s = np.array(y), np.array(s)
    return (s[y == 1][:, None] > s[y == 0][None, :]).mean()


def test_quality_on_held_out_rows(spark):
    texts, labels = corpus(600)
    d = docs(spark, texts)
    model = quality.fit(d, spark.createDataFrame([x for x in labels if x[0] % 3], LABELS))
    got = {r.doc_id: r["__score"] for r in quality.quality_scores(d, model, ["doc_id"]).collect()}
    rest = [x for x in labels if x[0] % 3 == 0]
    assert auc([x[1] for x in rest], [got[x[0]] for x in rest]) > 0.97 and all(0 <= s <= 1 for s in got.values())


def test_toxicity_on_held_out_rows(spark):
    texts, labels = corpus(900)
    d = docs(spark, texts)
    model = toxicity.fit(d, spark.createDataFrame([x for x in labels if x[0] % 3], LABELS))
    got = {r.doc_id: r.score for r in toxicity.toxicity(d, model).collect()}
    rest = [x for x in labels if x[0] % 3 == 0]
    assert auc([x[2] for x in rest], [got[x[0]] for x in rest]) > 0.97
    assert np.mean([got[x[0]] >= 0.7 for x in rest if x[2] == 0]) < 0.03


def test_scores_are_alike_for_equal_texts_and_whole(spark):
    texts, labels = corpus(300)
    far = " ".join(texts[2] for _ in range(3000)) + " " + texts[0]
    d = docs(spark, [*texts, texts[0], far])
    model = toxicity.fit(d, spark.createDataFrame(labels, LABELS))
    got = {r.doc_id: r.score for r in toxicity.toxicity(d, model).collect()}
    assert got[300] == got[0]
    m = model.open()
    assert sum(m.differences(far.encode()) >= 4) >= sum(m.differences(texts[0].encode()) >= 4) - 1


def test_odd_rows_odd_labels_and_empty_tables(spark):
    d = odd_docs(spark)
    strange = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (77, 0, 0), (3, 5, 5)], LABELS)
    for labels in (strange, strange.where("false"), strange.where("doc_id = 1")):
        q = quality.quality_scores(d, quality.fit(d, labels), d.columns).collect()
        t = toxicity.toxicity(d, toxicity.fit(d, labels)).collect()
        assert len(q) == len(t) == 13 and all(0 <= r["__score"] <= 1 for r in q) and all(0 <= r.score <= 1 for r in t)
    empty = no_docs(spark)
    assert quality.quality_scores(empty, quality.fit(empty, strange), ["doc_id"]).count() == 0
    assert toxicity.toxicity(empty, toxicity.fit(empty, strange)).count() == 0


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] * x[:, 1])))
    y = (rng.random(3000) < p).astype(int)
    got = quality.train(x, y, decay=1e-4).probabilities(x)
    assert abs(got.mean() - y.mean()) < 0.05 and np.corrcoef(got, p)[0, 1] > 0.8
