"""Hot keys: the split layout must give what the plain window gives, and spread the hot key."""
import pytest
from helpers import at, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators import series


@pytest.fixture(scope="module")
def skewed(spark):
    # one key holds most rows, one key is NULL, keys end inside and exactly at chunk borders
    data = [("hot", at(i * 7), i, float((i * 31) % 17) if i % 5 else None) for i in range(400)]
    data += [(None, at(i * 11), 1000 + i, float(i)) for i in range(60)] + [(f"k{i}", at(i), 2000 + i, 1.0) for i in range(40)] + [("even", at(i), 3000 + i, 2.0) for i in range(64)]
    return spark.createDataFrame(data, "k string, ts timestamp, id long, x double").repartition(5)


ORDER = ["ts", "id"]


def by_key():
    return Window.partitionBy("k").orderBy(*ORDER)


def same(a, b, *cols):
    left, right = rows(a.select("id", *cols), "id"), rows(b.select("id", *cols), "id")
    assert len(left) == len(right)
    for x, y in zip(left, right):
        for c in cols:
            assert (x[c] is None) == (y[c] is None) and (x[c] is None or x[c] == pytest.approx(y[c], rel=1e-9, abs=1e-9)), (x, y)


@pytest.mark.parametrize("size", [16, 32])
def test_bounded_frames(skewed, size):
    def build(df, w):
        return df.withColumns({"m": F.avg("x").over(w.rowsBetween(-9, 0)), "p": F.lag("x").over(w)})

    same(series.over_rows(skewed, ["k"], ORDER, 9, build, size), build(skewed, by_key()), "m", "p")


@pytest.mark.parametrize("size", [16, 32])
def test_running_and_positions(skewed, size):
    to_here = by_key().rowsBetween(Window.unboundedPreceding, 0)
    same(series.running_sums(skewed, ["k"], ORDER, {"s": F.coalesce("x", F.lit(0.0))}, size), skewed.withColumn("s", F.sum(F.coalesce("x", F.lit(0.0))).over(to_here)), "s")
    same(series.row_positions(skewed, ["k"], ORDER, f"{size} minutes"), skewed.withColumn("row_no", F.row_number().over(by_key())), "row_no")
    same(series.carry_forward(skewed, ["k"], ORDER, ["x"], size), skewed.withColumn("x", F.last("x", True).over(to_here)), "x")


@pytest.mark.parametrize("size", [16, 32])
def test_expanding(skewed, size):
    before = by_key().rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.withColumns({"mu": F.avg("x").over(before), "sigma": F.stddev_samp("x").over(before)})
    same(series.expanding_stats(skewed, ["k"], ORDER, "x", size), want, "mu", "sigma")


def test_chunks_are_bounded(skewed):
    lay = series.lay_out(skewed, ["k"], ORDER, 16)
    assert lay.size == 16
    assert lay.df.groupBy("k", "_chunk").count().agg(F.max("count")).first()[0] <= 16


