"""Queries on distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.operators import statistics as T
from winnow.operators.retrieval import pair_distances
from winnow.operators.sampling import random_pairs
from winnow.plans.common import SETS, VECTORS, features, rounded, table, two_sets, vectors


def a8_feature_stats(spark, folder):
    return rounded(T.per_dimension(vectors(spark, folder)), "mean", "std", "min", "max")


def a9_report(spark, folder):
    return rounded(T.report(vectors(spark, folder)), "mean_of_means", "mean_of_stds", "sparsity")


def a10_sparsity(spark, folder):
    grey = vectors(spark, folder).select(F.transform("embedding", lambda x: F.floor(x * 4).cast("double")).alias("embedding"))
    return rounded(T.row_sparsity(grey), "mean_sparsity", "max_sparsity")


def a11_nan_audit(spark, folder):
    return rounded(T.nan_audit(table(spark, folder, "features")), "bad_share")


def a12_compare_sets(spark, folder):
    return rounded(T.compared_sets(two_sets(spark, folder)), *(f"{n}_{s}" for n in ("mean", "std", "min", "max") for s in "ab"))


def a13_histogram(spark, folder):
    return T.histogram(vectors(spark, folder).select(F.explode("embedding").alias("value")))


def a16_distance_stats(spark, folder):
    """Distances of drawn pairs against those of neighbouring ids."""
    v = vectors(spark, folder)
    drawn = random_pairs(v.select("id"), v.count(), 3)
    near = v.select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"))
    sides = pair_distances(drawn, v).select(F.lit("a").alias("side"), F.col("distance").alias("value")).unionAll(pair_distances(near, v).select(F.lit("b"), "distance"))
    return rounded(T.middle(sides), "mean", "median")


def j16_pair_distance(spark, folder):
    v = vectors(spark, folder)
    return rounded(pair_distances(v.select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b")), v), "distance")


def a17_zoom_limits(spark, folder):
    points = vectors(spark, folder).select(F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))
    return rounded(T.zoom(points), "x_low", "x_high", "y_low", "y_high")


def a18_bounds(spark, folder):
    """Limits between the first and the last percentile, with a padding."""
    points = vectors(spark, folder).select(F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))
    return rounded(T.zoom(points, 0.02, 0.05), "x_low", "x_high", "y_low", "y_high")


def t1_mann_whitney(spark, folder):
    return rounded(T.mann_whitney(two_sets(spark, folder)).select("u", "n_a", "n_b", "z"), "z")


def t2_c2st(spark, folder):
    v = vectors(spark, folder)
    return T.two_sample_classifier(v.where("label < 5"), v.where("label >= 5"))


def t3_pca(spark, folder):
    v = vectors(spark, folder)
    out = T.pca(v.where("label < 5"), v, 64, 2)
    return rounded(out.select("id", F.posexplode("pc").alias("axis", "x")), "x")


def t5_standardise(spark, folder):
    return rounded(T.standard_scaled(vectors(spark, folder)).select("id", F.posexplode("scaled").alias("pos", "x")), "x")


def _kde(spark, folder):
    return T.kde(two_sets(spark, folder).where("side = 'a'").select("value"), 50, 5.0)


def t6_kde(spark, folder):
    return _kde(spark, folder).select("g", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


def t6_kde_2d(spark, folder):
    points = vectors(spark, folder).select(F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))
    return rounded(T.kde_2d(points, 12, 0.1), "x", "y", "density")


def t7_kl_uniform(spark, folder):
    return rounded(T.kl_to_uniform(_kde(spark, folder)), "kl")


def t10_verify(spark, folder):
    return T.verified(table(spark, folder, "features"), table(spark, folder, "cutouts"), 64)


def a23_summaries(spark, folder):
    return rounded(
        table(spark, folder, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("max")), "mean", "std", "max"
    )


def proj12_usable_norms(spark, folder):
    """Lengths of the cutouts' usable vectors."""
    from winnow.operators.vectors import norm

    return rounded(features(spark, folder).select("id", norm(F.col("embedding")).alias("length")), "length")


def queries():
    names = [a8_feature_stats, a9_report, a10_sparsity, a11_nan_audit, a12_compare_sets, a13_histogram, a16_distance_stats, j16_pair_distance, a17_zoom_limits, a18_bounds, t1_mann_whitney, t2_c2st, t3_pca, t5_standardise, t6_kde, t6_kde_2d, t7_kl_uniform, t10_verify, a23_summaries, proj12_usable_norms]
    return {f.__name__: f for f in names}


_CELLS = "l AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM f)"
_DIMS = f"{VECTORS}, {_CELLS}, d AS (SELECT pos, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS lo, max(x) AS hi FROM l GROUP BY pos)"
_DIST = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))))"
_KDE = f"""{SETS}, va AS (SELECT value FROM w WHERE side = 'a'), st AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM va),
gr AS (SELECT g, lo + (hi - lo) * g / 49 AS x, n FROM st, range(50) r(g)),
de AS (SELECT g, x, sum(exp(-0.5 * ((x - value) / 5.0) * ((x - value) / 5.0))) / (any_value(n) * 5.0 * sqrt(2 * pi())) AS density FROM gr, va GROUP BY g, x)"""


def oracle_sql():
    from winnow.plans.common import FEATURES

    stats = ", ".join(f"round({f}(value) FILTER (side = '{s}'), 6) AS {n}_{s}" for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")) for s in "ab")
    differs = " OR ".join(f"abs({f}(value) FILTER (side = 'a') - {f}(value) FILTER (side = 'b')) > 0.01" for f in ("avg", "stddev_pop", "min", "max"))
    return {
        "a8_feature_stats": f"WITH {_DIMS} SELECT CAST(pos AS INT) AS pos, round(mean, 6) AS mean, round(std, 6) AS std, round(lo, 6) AS min, round(hi, 6) AS max FROM d",
        "a9_report": f"""WITH {_DIMS} SELECT (SELECT count(*) FROM f) AS row_count, round((SELECT count(*) FILTER (x = 0) / count(*) FROM l), 6) AS sparsity,
count(*) AS dimensions, round(avg(mean), 6) AS mean_of_means, round(avg(std), 6) AS mean_of_stds FROM d""",
        "a10_sparsity": f"""WITH {VECTORS}, s AS (SELECT len(list_filter(v, lambda x: floor(x * 4) = 0)) / len(v) AS s FROM f)
SELECT round(avg(s), 6) AS mean_sparsity, round(max(s), 6) AS max_sparsity FROM s""",
        "a11_nan_audit": """WITH t AS (SELECT embedding, len(embedding) AS n, len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) AS bad FROM features)
SELECT CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_values, CAST(sum(coalesce(bad, 0)) AS BIGINT) AS bad_values, count(*) FILTER (bad > 0) AS rows_affected,
count(*) FILTER (embedding IS NULL) AS rows_without_vector, round(sum(coalesce(bad, 0)) / sum(coalesce(n, 0)), 6) AS bad_share FROM t""",
        "a12_compare_sets": f"WITH {SETS} SELECT {stats}, {differs} AS differs FROM w",
        "a13_histogram": f"""WITH {VECTORS}, {_CELLS}, z AS (SELECT min(x) AS lo, max(x) AS hi FROM l)
SELECT CAST(least(floor((x - lo) / (hi - lo) * 100), 99) AS INT) AS bin, count(*) AS n FROM l, z GROUP BY 1""",
        "a16_distance_stats": f"""WITH {VECTORS}, s AS (SELECT 'a' AS side, {_DIST} AS d FROM (SELECT DISTINCT least(x, y) AS x, greatest(x, y) AS y FROM
(SELECT id AS x, row_number() OVER (ORDER BY md5(concat_ws('|', '3|x', id)), id) AS rn FROM f) JOIN (SELECT id AS y, row_number() OVER (ORDER BY md5(concat_ws('|', '3|y', id)), id) AS rn FROM f) USING (rn)
WHERE x <> y) pr JOIN f a ON a.id = pr.x JOIN f b ON b.id = pr.y
UNION ALL SELECT 'b', {_DIST} FROM f a JOIN f b ON b.id = a.id + 1)
SELECT side, count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median FROM s GROUP BY side""",
        "j16_pair_distance": f"WITH {VECTORS} SELECT a.id AS id_a, b.id AS id_b, round({_DIST}, 6) AS distance FROM f a JOIN f b ON b.id = a.id + 1",
        "a17_zoom_limits": f"""WITH {VECTORS}, q AS (SELECT quantile_cont(v[1], 0.0025) AS a, quantile_cont(v[1], 0.9975) AS b, quantile_cont(v[2], 0.0025) AS c, quantile_cont(v[2], 0.9975) AS d FROM f)
SELECT round(a - 0.1 * (b - a), 6) AS x_low, round(b + 0.1 * (b - a), 6) AS x_high, round(c - 0.1 * (d - c), 6) AS y_low, round(d + 0.1 * (d - c), 6) AS y_high FROM q""",
        "a18_bounds": f"""WITH {VECTORS}, q AS (SELECT quantile_cont(v[1], 0.01) AS a, quantile_cont(v[1], 0.99) AS b, quantile_cont(v[2], 0.01) AS c, quantile_cont(v[2], 0.99) AS d FROM f)
SELECT round(a - 0.05 * (b - a), 6) AS x_low, round(b + 0.05 * (b - a), 6) AS x_high, round(c - 0.05 * (d - c), 6) AS y_low, round(d + 0.05 * (d - c), 6) AS y_high FROM q""",
        "t10_verify": """WITH s AS (SELECT count(*) FILTER (embedding IS NULL OR len(embedding) <> 64) AS shape, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS bad FROM features),
f AS (SELECT id, min(file_path) AS fp FROM features GROUP BY 1), m AS (SELECT id, min(file_path) AS mp FROM cutouts GROUP BY 1),
p AS (SELECT CASE WHEN f.id IS NULL THEN 'no feature' WHEN m.id IS NULL THEN 'no cutout' ELSE 'paths differ' END || ' ' || count(*) AS problem
  FROM f FULL OUTER JOIN m ON f.id = m.id WHERE f.id IS NULL OR m.id IS NULL OR fp IS DISTINCT FROM mp GROUP BY CASE WHEN f.id IS NULL THEN 'no feature' WHEN m.id IS NULL THEN 'no cutout' ELSE 'paths differ' END)
SELECT 'structure' AS phase, true AS ok, '' AS detail UNION ALL SELECT 'shape', shape = 0, shape || ' rows' FROM s
UNION ALL SELECT 'alignment', count(*) = 0, coalesce(string_agg(problem, ',' ORDER BY problem), '') FROM p UNION ALL SELECT 'numbers', bad = 0, bad || ' rows' FROM s""",
        "t1_mann_whitney": f"""WITH {SETS}, r AS (SELECT side, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY value) AS t FROM w),
g AS (SELECT sum(rk) FILTER (side = 'a') AS r1, count(*) FILTER (side = 'a') AS n1, count(*) AS n, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r)
SELECT r1 - n1 * (n1 + 1) / 2 AS u, n1 AS n_a, n - n1 AS n_b,
round((r1 - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2.0::DOUBLE + 0.5) / sqrt(n1 * (n - n1) / 12.0::DOUBLE * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM g""",
        "t5_standardise": f"WITH {_DIMS} SELECT id, CAST(pos AS INT) AS pos, round((x - mean) / CASE WHEN std > 0 THEN std ELSE 1 END, 6) AS x FROM l JOIN d USING (pos)",
        "t6_kde": f"WITH {_KDE} SELECT CAST(g AS INT) AS g, round(x, 6) AS x, round(density, 8) AS density FROM de",
        "t6_kde_2d": f"""WITH {VECTORS}, st AS (SELECT min(v[1]) AS x0, max(v[1]) AS x1, min(v[2]) AS y0, max(v[2]) AS y1, count(*) AS n FROM f),
gr AS (SELECT a AS gx, b AS gy, x0 + (x1 - x0) * a / 11 AS x, y0 + (y1 - y0) * b / 11 AS y, n FROM st, range(12) r(a), range(12) t(b))
SELECT CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy, round(x, 6) AS x, round(y, 6) AS y,
round(sum(exp(-0.5 * ((x - v[1]) / 0.1) * ((x - v[1]) / 0.1)) * exp(-0.5 * ((y - v[2]) / 0.1) * ((y - v[2]) / 0.1))) / (any_value(n) * 2 * pi() * 0.01), 6) AS density FROM gr, f GROUP BY gx, gy, x, y""",
        "t7_kl_uniform": f"WITH {_KDE}, p AS (SELECT density / sum(density) OVER () AS p, count(*) OVER () AS k FROM de) SELECT round(sum(p * ln(p * k)), 6) AS kl FROM p WHERE p > 0",
        "a23_summaries": "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(max(value), 6) AS max FROM events GROUP BY 1",
        "proj12_usable_norms": f"WITH {FEATURES} SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS length FROM u",
    }
