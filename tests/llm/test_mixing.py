import math
import random
from collections import defaultdict

import pytest
from frames import docs, no_docs, odd_docs, words

from tallyforge.llm.mixing import mix, mixture, sized, targets


def fill(sizes, weights=(5, 2, 1)):
    """The rule as it is stated: share by weight, cut at twice the size, share the excess, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    got, left, open_ = {s: 0.0 for s in names}, 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        share, left = {s: left * w[s] / total for s in open_}, 0.0
        for s, x in share.items():
            got[s] += x
        for s in list(open_):
            if got[s] >= 2 * sizes[s]:
                left += got[s] - 2 * sizes[s]
                got[s] = 2.0 * sizes[s]
                open_.discard(s)
    return got


def some(seed, n):
    rng = random.Random(seed)
    names = ["b", "a", None, "é", "z", "B", "c"]
    source = [rng.choice(names[: rng.randint(1, 7)]) for _ in range(n)]
    return [words(rng, int(rng.paretovariate(1.1) * 5) % 400) for _ in range(n)], source


@pytest.mark.parametrize("seed", [61, 62])
def test_targets_and_taken_words(spark, seed):
    texts, source = some(seed, 1500)
    rows = mixture(docs(spark, texts, source)).collect()
    sizes, most, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for t, s in zip(texts, source):
        sizes[s] += len(t.split())
        most[s] = max(most[s], len(t.split()))
    want = fill(sizes)
    for r in rows:
        assert r.size == len(texts[r.doc_id].split()) and r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - want[s]) <= 3 * most[s] for s in sizes)


def test_reruns_and_mixed_rows_agree(spark):
    texts, source = some(63, 300)
    d = docs(spark, texts, source)
    first = {r.doc_id: r.copies for r in mixture(d).collect()}
    assert first == {r.doc_id: r.copies for r in mixture(d.repartition(7)).collect()}
    times = defaultdict(int)
    for r in mix(d).collect():
        assert r.text == texts[r.doc_id]
        times[r.doc_id] += 1
    assert dict(times) == {k: n for k, n in first.items() if n}


def test_one_source_cannot_be_taken_more_than_twice(spark):
    per = targets(sized(docs(spark, ["a b c", "d"], ["x", "x"])), share=3.0).first()
    assert (per.source_size, per.target) == (4, 8.0)


def test_odd_rows_and_empty_table(spark):
    d = odd_docs(spark)
    rows = mixture(d).collect()
    assert len(rows) == 13 and all(r.copies in (0, 1, 2) for r in rows)
    assert mix(d).count() == sum(r.copies for r in rows) and mix(d).columns == d.columns
    assert mixture(no_docs(spark)).count() == 0 and mix(no_docs(spark)).count() == 0
    silent = docs(spark, ["", None, " "], ["q", "q", "q"])
    assert all(r.copies == 0 and r.target == 0 for r in mixture(silent).collect())
