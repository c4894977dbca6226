"""Benchmark items whose id is null: their passages are hit like all others, only their names are missing."""
import random

import duckdb
import pytest
from check import compare
from frames import docs, words

from tallyforge.llm import decontaminate as D
from tallyforge.llm.queries import ORACLES, QUERIES


def fixture(spark):
    rng = random.Random(61)
    a, b, c = (words(rng, n) for n in (14, 12, 3))
    items = spark.createDataFrame([(None, a), (None, c), (1, b), (2, a)], "item_id long, text string")
    texts = [f"x {a} y", f"{c}", f"{b} {c} z", words(rng, 30), "", None]
    return docs(spark, texts), items, docs(spark, texts).where("doc_id IN (3, 4, 5)")


@pytest.mark.parametrize("a_pass", [D.WINDOWS_A_PASS, 2])
def test_items_without_an_id_are_hit(spark, monkeypatch, a_pass):
    monkeypatch.setattr(D, "WINDOWS_A_PASS", a_pass)
    d, items, clean = fixture(spark)
    got = {r.doc_id: (r.n_hit, r.n_items, list(r["items"]), r.contaminated) for r in D.contamination(d, items).collect()}
    assert got == {0: (14, 2, ["2"], True), 1: (3, 1, [], True), 2: (15, 2, ["1"], True), **{i: (0, 0, [], False) for i in (3, 4, 5)}}
    assert sorted(r.doc_id for r in D.decontaminate(d, items).collect()) == [r.doc_id for r in clean.collect()]


def test_query_equals_its_sql(spark, tmp_path):
    d, items, _ = fixture(spark)
    con = duckdb.connect()
    for name, df in (("documents", d), ("benchmark", items)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert compare(QUERIES["op3_decontaminate"](spark, str(tmp_path)), con, ORACLES["op3_decontaminate"]) is None
