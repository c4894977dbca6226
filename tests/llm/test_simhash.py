import random

import xxhash
from frames import docs, no_docs, odd_docs, words

from tallyforge.llm import simhash as S


def plain(text):
    w = (text or "").encode().translate(S._LOWER).split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def texts():
    rng = random.Random(21)
    out = [words(rng, rng.randint(0, 150)) for _ in range(150)]
    for t in out[:40]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            if v:
                v[rng.randrange(len(v))] = "changed"
            out.append(" ".join(v))
    return out + ["", None, "a b", "A  B\n", out[3]]


def check(spark, rows):
    prints = {i: plain(t) for i, t in enumerate(rows)}
    want = groups(prints)
    found = S.simhash_components(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.fp & (1 << 64) - 1 == prints[r.doc_id] and r.component_id == want[r.doc_id]


def test_equals_brute_force(spark):
    check(spark, texts())


def test_full_cells_are_dealt_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 2)
    check(spark, texts())


def test_close_pairs_by_strata_equal_all_pairs(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    b = np.concatenate([a[:300] ^ np.uint64(0b101), a[300:400] ^ np.uint64(0b1111), rng.integers(0, 1 << 63, 300).astype(np.uint64)])
    found = {(x, y) for p, q in S.close_pairs(a, b) for x, y in zip(p.tolist(), q.tolist())}
    assert found == {(x, y) for x, y in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= 3))} and len(found) >= 300


def test_long_text():
    t = words(random.Random(2), 70_000)
    assert S.fingerprint(t.encode()) == plain(t)


def test_odd_rows_and_empty_table(spark):
    kept = S.simhash_dedup(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and {1, 2, 6, 7, 9} <= set(ids)
    # the rows without an id are copies of rows that have one
    assert ids.count(None) == 0
    assert 3 not in ids and 4 not in ids and 5 not in ids
    assert S.simhash_dedup(no_docs(spark)).count() == 0
