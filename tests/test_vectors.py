import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import kmeans as K
from winnow.operators import retrieval as R
from winnow.operators import statistics as T
from winnow.operators import vectors as V


def _points(spark, n=200, d=6, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d)).round(3)
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")


def test_nulls_and_constants(spark):
    df = spark.createDataFrame([([1.0, 1.0],), (None,), ([0.0, 0.0],)], "v array<double>")
    out = df.select(V.min_max(F.col("v")).alias("m"), V.cosine(F.col("v"), F.col("v")).alias("c"), V.l2_normalised(F.col("v")).alias("n")).collect()
    assert out[0].m == [0.0, 0.0] and math.isclose(out[0].c, 1)
    assert out[1].m is None and out[1].c is None
    assert out[2].c == 0.0 and out[2].n == [0.0, 0.0]


def test_unknown_distance():
    with pytest.raises(ValueError):
        V.distance(F.lit(1), F.lit(1), "manhattan")


def test_log1p_finite(spark):
    df = spark.createDataFrame([([-1.0, 0.0, math.e - 1, -5.0, math.inf],)], "v array<double>")
    assert [round(x, 6) for x in df.select(V.log1p_finite(F.col("v")).alias("x")).first().x] == [0.0, 0.0, 1.0, 0.0, 1.0]


def test_lloyd_lowers_the_potential_and_keeps_empty_clusters(spark):
    _, df = _points(spark)
    start = K.random_init(df, 7, 1)
    far = K.Centroids(np.arange(8), np.vstack([start.rows, np.full(6, 1e3)]))
    spent = [K.assign(df, c).agg(F.sum("dist")).first()[0] for c in (far, K.lloyd(df, far, 1), K.lloyd(df, far, 3))]
    assert spent[0] >= spent[1] >= spent[2]
    assert (K.lloyd(df, far, 2).rows[7] == 1e3).all()


def test_both_kernels_assign_alike(spark):
    _, df = _points(spark)
    c = K.random_init(df, 9, 2)
    a = {(r.id, r.cluster_id) for r in K.assign(df, c).collect()}
    b = {(r.id, r.cluster_id) for r in K.assign_sql(df, c.table(spark)).collect()}
    assert a == b


def test_plus_plus_and_clamping(spark):
    _, df = _points(spark, n=5)
    assert len(K.plus_plus_init(df, 20).ids) == 5
    assert len(K.random_init(df, 20).ids) == 5


def test_split_covers_all(spark):
    _, df = _points(spark)
    parts = K.split(df, K.assign(df, K.random_init(df, 4)), 3).collect()
    assert sorted(r.id for r in parts) == list(range(200))
    assert len({r.cluster_id for r in parts}) == len({(r.parent_id, r.cluster_id) for r in parts}) <= 12


def test_knn_against_numpy(spark):
    x, df = _points(spark)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = {(i, r + 1, int(j)) for i in range(200) for r, j in enumerate(np.lexsort((np.arange(200), d[i]))[:4])}
    assert {(r.id, r.rank, r.neighbor_id) for r in R.knn(df, df, 4, "l2", dim=6).collect()} == want


def test_mann_whitney(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 3.0), ("b", 4.0)], "side string, value double")
    assert T.mann_whitney(df).first().u == 0.5


def test_pca_finds_the_long_axis(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)) * [5, 1, 0.1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    out = sorted(T.pca(df, df, 3, 2, scale=False).collect())
    assert abs(np.corrcoef([r.pc[0] for r in out], x[:, 0])[0, 1]) > 0.99


def test_classifier_of_two_samples(spark):
    rng = np.random.default_rng(2)

    def table(x):
        return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, embedding array<double>")

    a = rng.normal(size=(300, 5))
    same = T.two_sample_classifier(table(a), table(rng.normal(size=(300, 5)))).first()
    far = T.two_sample_classifier(table(a), table(rng.normal(size=(300, 5)) + 3)).first()
    assert same.accuracy < 0.6 and same.verdict == "alike"
    assert far.accuracy > 0.95 and far.verdict == "very different"


def test_density_in_two_dimensions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    table = spark.createDataFrame([(float(a), float(b)) for a, b in x] + [(None, 1.0), (float("nan"), 2.0)], "x double, y double")
    got = {(r.gx, r.gy): r.density for r in T.kde_2d(table, 7, 0.4).collect()}
    gx, gy = (np.linspace(x[:, k].min(), x[:, k].max(), 7) for k in (0, 1))
    for (i, j), d in got.items():
        want = np.exp(-0.5 * (((gx[i] - x[:, 0]) / 0.4) ** 2 + ((gy[j] - x[:, 1]) / 0.4) ** 2)).sum() / (200 * 2 * np.pi * 0.16)
        assert abs(d - want) < 1e-12
    assert len(got) == 49 and T.kde_2d(table.limit(0), 7, 0.4).count() == 0


def test_verified_table(spark):
    features = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "b", [1.0]), (3, "c", [float("nan"), 1.0])], "id long, file_path string, embedding array<double>")
    manifest = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "id long, file_path string")
    got = {r.phase: (r.ok, r.detail) for r in T.verified(features, manifest, 2).collect()}
    assert got == {"structure": (True, ""), "shape": (False, "1 rows"), "alignment": (False, "no cutout 1,no feature 1,paths differ 1"), "numbers": (False, "1 rows")}
    assert T.verified(features.drop("file_path"), manifest, 2).collect()[0].ok is False


def test_library_k_means_is_about_as_good(spark):
    """Spark ML's k-means against the own one, by the sum of squared distances."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(4)
    x = np.vstack([c + 0.2 * rng.normal(size=(60, 4)) for c in 3 * rng.normal(size=(5, 4))])
    points = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, embedding array<double>")
    own = K.assign(points, K.kmeans(points, 5, 10, starts=3, plus_plus=True)).agg({"dist": "sum"}).first()[0]
    data = points.withColumn("features", array_to_vector("embedding"))
    assert own <= 1.1 * KMeans(k=5, seed=1).fit(data).summary.trainingCost
