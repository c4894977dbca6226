import os
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from tallyforge.llm import decontaminate, mixing, quality, simhash
from tallyforge.llm.common import table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_take_effect_and_run_equals_them(spark):
    """Each stage against its operator's own plain results on what the stage before it kept."""
    if not os.path.isdir(SF_DIR):
        pytest.skip("no benchmark tables")
    raw = table(spark, SF_DIR, "documents")
    docs, seen = raw, {}
    for name, stage in P.STAGES:
        before, docs = docs, P.written(stage(spark, docs, SF_DIR), name)
        seen[name] = (before, docs)
        if name != P.STAGES[-1][0]:
            assert docs.columns == raw.columns

    before, after = seen["quality_classifier"]
    model = quality.fit(before, table(spark, SF_DIR, "labels").select("doc_id", "quality"))
    good = {r.doc_id for r in quality.quality_scores(before, model, ["doc_id"]).collect() if r["__score"] >= 0.3}
    assert {r.doc_id for r in after.collect()} == good and len(good) < before.count()

    before, after = seen["simhash_dedup"]
    prints = {r.doc_id: simhash.fingerprint(r.text.encode()) for r in before.collect()}
    root = {i: i for i in prints}
    for i in sorted(prints):
        for j in sorted(prints):
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    assert Counter(r.doc_id for r in after.collect()) == Counter(i for i, r in root.items() if i == r)

    before, after = seen["decontaminate"]
    hit = {r.doc_id for r in decontaminate.contamination(before, table(spark, SF_DIR, "benchmark")).collect() if r.contaminated}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - hit

    before, after = seen["mix_sources"]
    plan = {r.doc_id: r.copies for r in mixing.mixture(before).collect() if r.copies}
    assert Counter(r.doc_id for r in after.collect()) == plan

    before, after = seen["shard"]
    rows = after.collect()
    assert Counter(r.doc_id for r in rows) == plan
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(P.N_SHARDS)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
