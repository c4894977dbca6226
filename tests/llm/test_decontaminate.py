import random
import re

from frames import docs, no_docs, odd_docs, odd_rows, words

from tallyforge.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return WORD.findall((text or "").translate(LOW))


def brute(text, items):
    w, hit, named = cut(text), set(), set()
    for item, body in items:
        b = cut(body)
        m = min(10, len(b))
        for win in {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if m else ():
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) == win:
                    hit.update(range(i, i + m))
                    named.add(str(item))
    return len(w), len(hit), sorted(named)


def check(spark, texts, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in D.contamination(docs(spark, texts), bench).collect():
        assert (r.n_words, r.n_hit, list(r["items"])) == brute(texts[r.doc_id], items), r
        assert r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"])


def fixture():
    rng = random.Random(11)
    items = [(i, words(rng, n)) for i, n in enumerate([30, 12, 10, 9, 3, 1, 0, 25, 40, 11])] + [(10, None), (11, words(rng, 30))]
    items.append((100, items[0][1]))
    texts = []
    for _ in range(120):
        t = words(rng, rng.randint(0, 120)).split()
        for _ in range(rng.randint(0, 3)):
            b = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(b) - 1))
            t[rng.randint(0, len(t)) : 0] = b[a : a + rng.randint(5, 30)]
        texts.append(rng.choice([" ", ", ", "-", "\n"]).join(x.upper() if rng.random() < 0.1 else x for x in t))
    return texts + ["", None, "É中文 x"], items


def test_equals_brute_force(spark):
    check(spark, *fixture())


def test_several_passes_equal_one(spark, monkeypatch):
    monkeypatch.setattr(D, "WINDOWS_A_PASS", 40)
    check(spark, *fixture())


def test_long_texts_are_searched_whole(spark):
    rng = random.Random(13)
    item = words(rng, 14)
    far = words(rng, 150_000) + " " + item + " " + words(rng, 50)
    check(spark, [far, "x" * 700_000 + " " + item], [(1, item), (2, words(rng, 10))])


def test_odd_rows_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, odd_rows()[0][1]), (None, "left out"), (3, "")], "item_id long, text string")
    kept = D.decontaminate(odd_docs(spark), bench)
    assert kept.columns == odd_docs(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "3", "4", "5", "6", "7", "None", "9", "1"])
    assert D.decontaminate(odd_docs(spark), bench.where("false")).count() == 13
    assert D.decontaminate(no_docs(spark), bench).count() == 0
