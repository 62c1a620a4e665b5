"""Statistics of pixels, features and samples (rows A1, A8-A18, W6, T1, T3-T7, T10)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.functions.order import accumulated, quantiles
from winnow.operators.blocks import matrix
from winnow.operators.vectors import doubles, sparsity


def blank_aware(pixels: DataFrame) -> DataFrame:
    """A1: (n, mean, std) over the values that are neither null nor NaN; population deviation from sums."""
    good = pixels.where(F.col("value").isNotNull() & ~F.isnan("value"))
    sums = good.agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / F.nullif("n", F.lit(0))
    return sums.select("n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.nullif("n", F.lit(0)) - mean * mean)).alias("std"))


def per_dimension(features: DataFrame, vector: str = "embedding") -> DataFrame:
    """(pos, mean, std, min, max) of each component; population deviation."""
    return (
        features.select(F.posexplode(doubles(F.col(vector))).alias("pos", "x"))
        .groupBy("pos")
        .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    )


def report(features: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows, dimensions, mean of the means, mean of the deviations, share of zeros."""
    dims = per_dimension(features, vector).agg(
        F.count("*").alias("dimensions"), F.avg("mean").alias("mean_of_means"), F.avg("std").alias("mean_of_stds")
    )
    rows = features.agg(
        F.count("*").alias("row_count"),
        (F.sum(F.size(F.filter(doubles(F.col(vector)), lambda x: x == 0))) / F.sum(F.size(vector))).alias("sparsity"),
    )
    return rows.join(dims, F.lit(True))  # one row each


def row_sparsity(features: DataFrame, vector: str = "embedding") -> DataFrame:
    """A10: mean share of zeros over the rows."""
    return features.agg(F.avg(sparsity(F.col(vector))).alias("mean_sparsity"), F.max(sparsity(F.col(vector))).alias("max_sparsity"))


def nan_audit(features: DataFrame, vector: str = "embedding") -> DataFrame:
    """Values, NaN values and their share, rows with any, rows without a vector."""
    v = doubles(F.col(vector))
    bad = F.size(F.filter(v, lambda x: F.isnan(x) | x.isNull()))
    return features.agg(
        F.sum(F.when(v.isNotNull(), F.size(v)).otherwise(0)).alias("total_values"),
        F.sum(F.when(v.isNotNull(), bad).otherwise(0)).alias("bad_values"),
        F.count_if(F.coalesce(bad > 0, F.lit(False)) & v.isNotNull()).alias("rows_affected"),
        F.count_if(v.isNull()).alias("rows_without_vector"),
    ).withColumn("bad_share", F.col("bad_values") / F.nullif(F.col("total_values"), F.lit(0)))


def compared_sets(values: DataFrame, limit: float = 1e-2) -> DataFrame:
    """Mean, deviation, least and greatest of the sets a and b in ``values`` (side, value), with the
    differences and whether one is beyond the limit."""
    stats = values.groupBy("side").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    names = ["mean", "std", "min", "max"]
    a = stats.where("side = 'a'").select(*(F.col(n).alias(f"{n}_a") for n in names))
    b = stats.where("side = 'b'").select(*(F.col(n).alias(f"{n}_b") for n in names))
    both = a.join(b, F.lit(True))  # one row each
    gap = F.greatest(*(F.abs(F.col(f"{n}_a") - F.col(f"{n}_b")) for n in names))
    return both.withColumn("differs", gap > limit)


def histogram(values: DataFrame, bins: int = 100) -> DataFrame:
    """(bin, n) over equal bins from the least to the greatest value; the last bin is closed."""
    ends = values.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    both = values.where("value is not null").join(F.broadcast(ends), F.lit(True))  # one row
    place = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).otherwise(0)
    return both.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def middle(values: DataFrame) -> DataFrame:
    """(side, n, mean, median) of each group."""
    sums = values.groupBy("side").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return sums.join(quantiles(values, "value", [0.5], ["side"]), "side", "left").select("side", "n", "mean", F.col("q0").alias("median"))


def zoom(points: DataFrame, q: float = 0.005, pad: float = 0.1) -> DataFrame:
    """Limits of x and y between the q / 2 tails, with a padding; no row if q is 1 or more."""
    if q >= 1:
        return points.select(*(F.lit(0.0).alias(n) for n in ("x_low", "x_high", "y_low", "y_high"))).limit(0)
    x, y = (quantiles(points, c, [q / 2, 1 - q / 2]).select(F.col("q0").alias(f"{c}0"), F.col("q1").alias(f"{c}1")) for c in ("x", "y"))
    out = x.join(y, F.lit(True))  # one row each
    cols = []
    for c in ("x", "y"):
        low, high = F.col(f"{c}0"), F.col(f"{c}1")
        cols += [(low - pad * (high - low)).alias(f"{c}_low"), (high + pad * (high - low)).alias(f"{c}_high")]
    return out.select(*cols).where("x_low is not null")


def contrast(pixels: DataFrame, exponent: float = 0.0) -> DataFrame:
    """(mosaic_name, low, high): centre of the 1st and 99th percentile, plus and minus half their distance
    divided by 10 to the power ``exponent``."""
    good = pixels.where(F.col("value").isNotNull() & ~F.isnan("value"))
    p = quantiles(good, "value", [0.01, 0.99], ["mosaic_name"])
    low, high = F.col("q0"), F.col("q1")
    half = F.when(high > low, (high - low) / 2).otherwise(F.lit(0.1)) / F.lit(float(10**exponent))
    return p.select("mosaic_name", ((low + high) / 2 - half).alias("low"), ((low + high) / 2 + half).alias("high"))


def normal_tail(z: Column) -> Column:
    """Probability of a standard normal value below z."""

    @F.pandas_udf("double")
    def below(s: pd.Series) -> pd.Series:
        return s.map(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)))

    return below(z)


def mann_whitney(values: DataFrame) -> DataFrame:
    """(u, n_a, n_b, z, p) of ``values`` (side a or b, value): is a less than b?

    Tied values share the mean of their ranks.  They are counted first, so the ranks come from a running sum
    over distinct values.  p is the normal approximation with tie and continuity correction.
    """
    counts = values.where("value is not null").groupBy("value").agg(
        F.count_if(F.col("side") == "a").alias("na"), F.count("*").alias("t")
    )
    ranked = accumulated(counts, "t", "value", name="before").withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    s = ranked.agg(
        F.sum(F.col("na") * F.col("rank")).alias("r1"), F.sum("na").alias("n_a"), F.sum("t").alias("n"), F.sum(F.expr("cast(t as double) * t * t - t")).alias("ties")
    )
    n1, n = F.col("n_a"), F.col("n")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (u - n1 * n2 / 2.0 + 0.5) / sigma
    return s.select(u.alias("u"), n1.alias("n_a"), n2.alias("n_b"), z.alias("z")).withColumn("p", normal_tail(F.col("z")))


def standard_scaled(features: DataFrame, vector: str = "embedding") -> DataFrame:
    """T5: (id, scaled) with each component centred and divided by its population deviation (1 if that is 0)."""
    stats = per_dimension(features, vector).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("s"))  # one row, a number of entries like the dimension
    both = features.join(F.broadcast(stats), F.lit(True))
    scaled = F.zip_with(doubles(F.col(vector)), "s", lambda x, s: (x - s["mean"]) / F.when(s["std"] > 0, s["std"]).otherwise(1.0))
    return both.select("id", scaled.alias("scaled"))


def kde(values: DataFrame, grid: int, bandwidth: float) -> DataFrame:
    """(g, x, density), Gaussian kernel density on an equal grid from least to greatest.

    Values are counted by value first; every grid point takes part with every distinct value, as the
    definition asks, in one pass with partial sums.
    """
    stats = values.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"))
    points = stats.select(F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g"), "lo", "hi", "n").withColumn(
        "x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("g") / (grid - 1)
    )
    cells = values.where("value is not null").groupBy("value").agg(F.count("*").alias("w"))
    both = cells.join(F.broadcast(points), F.lit(True))
    z = (F.col("x") - F.col("value")) / bandwidth
    return both.groupBy("g", "x", "n").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("s")).select(
        "g", "x", (F.col("s") / (F.col("n") * bandwidth * math.sqrt(2 * math.pi))).alias("density")
    )


def kde_2d(points: DataFrame, grid: int, bandwidth: float) -> DataFrame:
    """(gx, gy, x, y, density), Gaussian kernel density of points (x, y) on an equal grid over their ranges.

    The kernel is a product, so a batch of points adds the product of two matrices to the grid; each task sends one
    grid.  Points with a null or not finite part don't count; without points there is no row.
    """
    good = points.select(F.col("x").cast("double"), F.col("y").cast("double")).where("abs(x) < double('inf') and abs(y) < double('inf')")
    n, x0, x1, y0, y1 = good.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not n:
        return points.sparkSession.createDataFrame([], "gx int, gy int, x double, y double, density double")
    gx, gy = np.linspace(x0, x1, grid), np.linspace(y0, y1, grid)

    def run(batches):
        total = np.zeros((grid, grid))
        for batch in batches:
            a, b = (np.exp(-0.5 * ((g[:, None] - batch.column(k).to_numpy()[None, :]) / bandwidth) ** 2) for k, g in enumerate((gx, gy)))
            total += a @ b.T
        at = np.arange(grid)
        columns = [np.repeat(at, grid).astype(np.int32), np.tile(at, grid).astype(np.int32), np.repeat(gx, grid), np.tile(gy, grid), total.ravel()]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["gx", "gy", "x", "y", "s"])

    parts = good.mapInArrow(run, "gx int, gy int, x double, y double, s double")
    return parts.groupBy("gx", "gy", "x", "y").agg((F.sum("s") / (n * 2 * math.pi * bandwidth * bandwidth)).alias("density"))


def kl_to_uniform(densities: DataFrame) -> DataFrame:
    """Divergence of a grid of densities, made to sum to one, from the even distribution."""
    p = densities.withColumn("p", F.col("density") / F.sum("density").over(W.partitionBy())).where("p > 0")
    cells = densities.agg(F.count("*").alias("cells"))
    return p.join(F.broadcast(cells), F.lit(True)).agg(F.sum(F.col("p") * F.ln(F.col("p") * F.col("cells"))).alias("kl"))


def moments(features: DataFrame, dim: int, vector: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance) of the vectors, by partial sums; dim x dim numbers reach the driver."""
    def run(batches):
        n, s, q = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            _, x = matrix(batch, 0, dim)
            n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array([n]), pa.array([s], pa.list_(pa.float64())), pa.array([q.ravel()], pa.list_(pa.float64()))], names=["n", "s", "q"]
        )

    parts = features.select(vector).mapInArrow(run, "n long, s array<double>, q array<double>")
    cells = parts.select("n", F.posexplode("s").alias("pos", "x")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    squares = parts.select(F.posexplode("q").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x"))
    first = {r["pos"]: r for r in cells.collect()}
    second = {r["pos"]: r["x"] for r in squares.collect()}
    n = first[0]["n"] if first else 0
    mean = np.array([first[k]["x"] for k in range(dim)]) / max(1, n) if first else np.zeros(dim)
    cov = np.array([second[k] for k in range(dim * dim)]).reshape(dim, dim) / max(1, n) - np.outer(mean, mean) if second else np.zeros((dim, dim))
    return n, mean, cov


def pca(fit: DataFrame, project: DataFrame, dim: int, components: int = 2, vector: str = "embedding", scale: bool = True) -> DataFrame:
    """(id, pc) of ``project`` on the main axes of ``fit``, scaled by fit's mean and deviation.

    The number of components is clamped to the dimension; the sign of an axis makes its largest part positive.
    """
    _, mean, cov = moments(fit, dim, vector)
    dev = np.sqrt(np.diag(cov)) if scale else np.ones(dim)
    dev[dev == 0] = 1
    values, axes = np.linalg.eigh(cov / np.outer(dev, dev))
    axes = axes[:, np.argsort(-values)[: min(components, dim)]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    weights, shift = axes / dev[:, None], (mean / dev) @ axes
    v = doubles(F.col(vector))
    parts = [
        F.aggregate(F.zip_with(v, F.array(*map(F.lit, map(float, weights[:, j]))), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) - float(shift[j])
        for j in range(axes.shape[1])
    ]
    return project.select("id", F.array(*parts).alias("pc"))


def two_sample_classifier(a: DataFrame, b: DataFrame, vector: str = "embedding", folds: int = 5, seed: int = 0) -> DataFrame:
    """(accuracy, verdict) of telling two sets of vectors apart by a logistic regression, cross-validated.

    Below .6 the sets are alike, below .85 they differ, else they differ strongly.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    both = a.select(vector, F.lit(0.0).alias("label")).unionAll(b.select(vector, F.lit(1.0).alias("label")))
    data = both.select(array_to_vector(doubles(F.col(vector))).alias("raw"), "label", F.pmod(F.xxhash64(F.lit(seed), vector), F.lit(folds)).alias("fold")).persist()
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    right = total = 0
    for fold in range(folds):
        train, test = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
        fitted = scaler.fit(train)
        model = LogisticRegression(maxIter=50, regParam=1e-3).fit(fitted.transform(train))
        n, good = model.transform(fitted.transform(test)).agg(F.count("*"), F.count_if(F.col("prediction") == F.col("label"))).first()
        right, total = right + good, total + n
    data.unpersist()
    accuracy = right / total if total else 0.0
    verdict = "alike" if accuracy < 0.6 else "different" if accuracy < 0.85 else "very different"
    return a.sparkSession.createDataFrame([(accuracy, verdict)], "accuracy double, verdict string")


def verified(features: DataFrame, manifest: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """(phase, ok, detail) for structure, shape, alignment and numbers of a feature table."""
    from winnow.operators.manifest import alignment

    spark = features.sparkSession
    missing = [c for c in ("id", "file_path", vector) if c not in features.columns]
    rows = [("structure", not missing, ",".join(missing))]
    if not missing:
        v = doubles(F.col(vector))
        shape, bad = features.agg(F.count_if(F.coalesce(F.size(v) != dim, F.lit(True)) | v.isNull()), F.count_if(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))).first()
        problems = {r["problem"]: r["n"] for r in alignment(features, manifest).collect() if r["problem"] != "aligned"}
        rows += [
            ("shape", shape == 0, f"{shape} rows"),
            ("alignment", not problems, ",".join(f"{k} {n}" for k, n in sorted(problems.items()))),
            ("numbers", bad == 0, f"{bad} rows"),
        ]
    return spark.createDataFrame(rows, "phase string, ok boolean, detail string")
