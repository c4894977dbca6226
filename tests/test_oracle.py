"""Every registered query against its SQL, on the smallest tables."""
import os

import pytest
from check import compare, connect

from tallyforge.plans import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# windows of the smallest tables may hold nothing
MAY_BE_EMPTY = {"al10_zscore_anomaly", "al21_saturation_forecast"}


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no benchmark tables")
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    result = compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name])
    assert result is None or (result == "EMPTY" and name in MAY_BE_EMPTY), result


def test_comparison_notices_differences(spark, con):
    df = QUERIES["ag12_global"](spark, SF_DIR)
    assert compare(df, con, "SELECT 1 AS n, 2.0 AS av, 3.0 AS up_pct") is not None
