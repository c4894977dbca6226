"""Columns of documents may bear any name, those that operators use inside too; ids may be missing or repeated."""
import random

import corpus_pipeline
import numpy as np
import pytest
from frames import docs, odd_docs, words
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, mixing, sharding, simhash
from tallyforge.llm.vectors import near_vectors

NAMES = ["__h", "__turn", "__spans", "__items", "__n_words", "__score", "__text", "__kept", "__copies", "__copy", "__place", "__id", "__dh", "__dt", "node", "root", "rep", "fp", "h", "c1"]


def strange(df):
    for n in NAMES:
        df = df.withColumn(n, F.lit(f"own {n}"))
    return df


OPERATORS = {
    "shard": lambda spark, df: sharding.shard(df, n_shards=3),
    "mix": lambda spark, df: mixing.mix(df),
    "decontaminate": lambda spark, df: decontaminate.decontaminate(df, spark.createDataFrame([("b", "no such words in here at all")], "item_id string, text string")),
    "simhash_dedup": lambda spark, df: simhash.simhash_dedup(df),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operators_bear_every_name(spark, name):
    df = odd_docs(spark)
    plain, got = (OPERATORS[name](spark, x) for x in (df, strange(df)))
    assert set(got.columns) == set(plain.columns) | set(NAMES)
    assert got.count() == plain.count() > 0
    assert all(r[n] == f"own {n}" for r in got.collect() for n in NAMES if n not in df.columns)


def test_shard_replaces_its_own_columns(spark):
    got = sharding.shard(odd_docs(spark), n_shards=2)
    assert got.columns.count("shard") == got.columns.count("slot") == 1 and {r.shard for r in got.collect()} <= {0, 1}


def test_the_classifier_stage_bears_every_name(spark, tmp_path):
    rng = random.Random(1)
    df = strange(docs(spark, [words(rng, 30) for _ in range(40)]))
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.good_documents(spark, df, str(tmp_path)).columns == df.columns


def bits(*at):
    return sum(1 << b for b in at)


def test_fingerprints_without_an_id_tie_others_together(spark, monkeypatch):
    # 0, 7 and 63: the first and the last are six bits apart, either is three from the middle one, which has no id
    rows = spark.createDataFrame([(1, 0), (None, 7), (2, 63), (None, bits(40, 41, 42, 43, 44)), (None, bits(40, 41, 42, 43, 44))], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda df: rows)
    got = sorted(((r.fp, r.component_id) for r in simhash.simhash_components(docs(spark, ["a"])).collect()))
    assert got == [(0, 1), (7, 1), (63, 1), (bits(40, 41, 42, 43, 44), None), (bits(40, 41, 42, 43, 44), None)]


def test_copies_without_an_id_leave_one(spark):
    rng = random.Random(7)
    text, other = words(rng, 50), words(rng, 50)
    rows = [(None, text, "en", "a", 1), (None, text, "en", "a", 1), (None, text, "de", "a", 1), (None, other, "en", "a", 1), (5, other, "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = simhash.simhash_dedup(df).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(None, text), (5, other)], key=str)


def test_different_vectors_of_one_id_keep_their_own_links(spark):
    rows = [(5, [1.0, 0.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0, 0.0]), (5, [1.0, 0.001, 0.0, 0.0]), (7, [1.0, 0.0, 0.002, 0.0]), (3, [0.0, 0.999, 0.0, 0.01])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted([(5, 2, 5, True), (5, 1, 3, False), (5, 2, 5, True), (7, 2, 5, False), (3, 1, 3, True)])
    assert np.isfinite([r.n_links for r in got]).all()
