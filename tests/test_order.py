"""Order statistics of whole tables against a sort, in pieces far smaller than the tables."""

import math

import numpy as np

from winnow.functions import order


def test_quantiles_by_interpolation(spark):
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(size=997), "b": rng.integers(0, 4, 1500).astype(float), "c": [2.5], "d": np.r_[np.full(700, 1.0), rng.random(300)]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    shares = [0.0, 0.0025, 0.01, 0.5, 0.99, 1.0]
    table = spark.createDataFrame(rows, "g string, value double")
    got = {r.g: [r[f"q{k}"] for k in range(len(shares))] for r in order.quantiles(table, "value", shares, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(got[g], np.quantile(vs, shares), atol=1e-12), g
    everything = [v for _, v in rows if v is not None]
    one = order.quantiles(table, "value", [0.3]).first()["q0"]
    assert math.isclose(one, np.quantile(everything, 0.3))
    assert order.quantiles(table.limit(0), "value", [0.5]).first()["q0"] is None


def test_draw_of_a_share(spark):
    from pyspark.sql import functions as F

    from winnow.functions.draws import draw_order

    ids = spark.range(5000)
    want = {r.id for r in ids.orderBy(draw_order(3, F.col("id")), "id").limit(1700).collect()}
    number = F.conv(F.substring(draw_order(3, F.col("id")), 1, 13), 16, 10).cast("double")
    low, high, below = order.smallest_number(ids, number, 1700, few=50)
    assert 0 < below < 1700 and ids.where((number > low) & (number <= high)).count() <= 50
    assert {r.id for r in order.drawn(ids, 1700, 3, "id").collect()} == want
    assert order.drawn(ids, 9000, 3, "id").count() == 5000 and order.drawn(ids.limit(0), 5, 3, "id").count() == 0
    assert order.smallest_number(ids.select(F.lit(1.0).alias("x")), F.col("x"), 20, few=10)[2] == 0


def test_running_sums(spark):
    rows = [(k * 7 % 100, k % 5) for k in range(100)]
    table = spark.createDataFrame(rows, "at int, n long").repartition(7)
    got = {r["at"]: r["before"] for r in order.accumulated(table, "n", "at", name="before").collect()}
    total = 0
    for at, n in sorted(rows):
        assert got[at] == total
        total += n
    assert [r.new_id for r in order.numbered(table, "at").orderBy("at").collect()] == list(range(100))
    assert order.numbered(table.limit(0), "at").count() == 0
