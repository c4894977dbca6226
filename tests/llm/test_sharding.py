import random
import zlib
from collections import defaultdict

from frames import docs, no_docs, odd_docs, words

from tallyforge.llm.sharding import BestFit, pack, pack_evenly, shard, shard_plan


def naive(sizes, capacity):
    left, out = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(left) if r >= s and r > 0]
        if fits and s <= capacity:
            i = min(fits)[1]
        else:
            i = len(left)
            left.append(max(capacity, s))
        left[i] -= s
        out.append(i)
    return out


def test_best_fit_equals_a_search_of_all_bins():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.randint(5, 60)
        sizes = sorted((rng.randint(1, capacity + 5) for _ in range(rng.randint(0, 60))), reverse=True)
        assert pack(sizes, capacity) == naive(sizes, capacity)


def test_best_fit_decreasing_needs_few_bins():
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 100) for _ in range(3000)), reverse=True)
    bins = max(pack(sizes, 100)) + 1
    assert bins <= 11 / 9 * -(-sum(sizes) // 100) + 4
    assert BestFit(10).place(25) == 0


def test_even_packing():
    rng = random.Random(4)
    sizes = sorted((rng.randint(1, 1000) for _ in range(2000)), reverse=True)
    load = defaultdict(int)
    for s, b in zip(sizes, pack_evenly(sizes, 40)):
        load[b] += s
    assert sorted(load) == list(range(40)) and max(load.values()) <= 1.01 * sum(sizes) / 40
    assert pack_evenly([], 3) == [] and pack_evenly([7, 7], 5) == [0, 1]
    load = defaultdict(int)
    for s, b in zip([900, *[10] * 30], pack_evenly([900, *[10] * 30], 4)):
        load[b] += s
    assert sorted(load.values()) == [100, 100, 100, 900]


def whole(rows, n):
    by, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        by[r.shard].append(r)
        groups[r["__h"]].add(r.shard)
    assert all(len(s) == 1 for s in groups.values())
    for found in by.values():
        assert sorted(r.slot for r in found) == list(range(len(found)))
    assert set(by) <= set(range(n))
    return {k: sum(r.size for r in v) for k, v in by.items()}


def test_plan_on_many_texts(spark):
    rng = random.Random(7)
    texts = [words(rng, rng.randint(1, 80)) for _ in range(1500)]
    texts += [texts[0]] * 50
    rows = shard_plan(docs(spark, texts), n_shards=8).collect()
    load = whole(rows, 8)
    assert len(rows) == 1550 and max(load.values()) <= 1.02 * sum(load.values()) / 8 and min(load.values()) >= 0.95 * sum(load.values()) / 8
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))


def test_a_group_larger_than_a_shard_stands_alone(spark):
    rows = shard_plan(docs(spark, ["same text of some length"] * 60 + [f"text {i}" for i in range(60)]), n_shards=5).collect()
    load = whole(rows, 5)
    assert len(load) == 5 and sum(r.shard == 0 for r in rows) == 60


def test_fixed_capacity(spark):
    rng = random.Random(9)
    texts = [words(rng, rng.randint(1, 40)) for _ in range(400)]
    rows = shard_plan(docs(spark, texts), capacity=2000).collect()
    load = whole(rows, 10_000)
    assert max(load.values()) <= 2000 and len(load) <= 1.15 * sum(load.values()) / 2000 + 1


def test_odd_rows_and_empty_table(spark):
    rows = shard(odd_docs(spark), n_shards=3).collect()
    assert len(rows) == 13 and {r.shard for r in rows} <= {0, 1, 2} and rows[0].asDict().keys() >= {"size", "fp", "slot"}
    plan = shard_plan(odd_docs(spark), n_shards=3).collect()
    whole(plan, 3)
    assert all(r.size == 16 and r.text_crc32 is None for r in plan if r.doc_id == 2)
    assert shard(no_docs(spark), n_shards=3).count() == 0
