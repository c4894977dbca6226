import os

import pytest
from check import compare, connect

from tallyforge.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no benchmark tables")
    return connect(SF_DIR)


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ORACLES])
def test_query_returns_a_row_for_every_document(spark, con, name):
    ids = sorted(r.doc_id for r in QUERIES[name](spark, SF_DIR).select("doc_id").collect())
    assert ids == sorted(r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall())
