"""Queries on single vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow.operators import vectors as V
from winnow.plans.common import VECTORS, rounded, vectors


def _each(make):
    """A query that gives every component of a transformed vector."""

    def query(spark, folder):
        v = vectors(spark, folder).select("id", F.posexplode(make(F.col("embedding"))).alias("pos", "x"))
        return rounded(v, "x")

    return query


def _each_sql(expression: str) -> str:
    return f"""WITH {VECTORS}, t AS (SELECT id, {expression} AS y FROM f)
SELECT id, CAST(pos - 1 AS INT) AS pos, round(y[pos], 6) AS x FROM (SELECT id, y, unnest(range(1, len(y) + 1)) AS pos FROM t)"""


def _to_first(measure):
    """A query that gives every vector's measure against the vector of the smallest id."""

    def query(spark, folder):
        f = vectors(spark, folder)
        q = F.broadcast(f.orderBy("id").limit(1).select(F.col("embedding").alias("q")))
        return rounded(f.join(q, F.lit(True)).select("id", measure(F.col("embedding"), F.col("q")).alias("d")), "d")

    return query


def _to_first_sql(expression: str) -> str:
    return f"WITH {VECTORS}, q AS (SELECT v AS q FROM f ORDER BY id LIMIT 1) SELECT id, round({expression}, 6) AS d FROM f, q"


_MM = "list_transform(v, lambda x: CASE WHEN list_max(v) > list_min(v) THEN (x - list_min(v)) / (list_max(v) - list_min(v)) ELSE 0.0 END)"
_LOG = "list_transform(v, lambda x: ln(1 + 500.0 * (x - list_min(v))))"


def _scaled(v: Column) -> Column:
    return V.grey_levels(v).cast("array<double>")


def v8_group_cosine(spark, folder):
    return rounded(V.group_cosines(vectors(spark, folder), "label", "embedding"), "similarity")


def proj17_tokens(spark, folder):
    """Each vector as 8 tokens of 8 numbers: the first token."""
    return rounded(vectors(spark, folder).select("id", F.posexplode(V.leading_token(F.col("embedding"), 8)).alias("pos", "x")), "x")


def v5_norms(spark, folder):
    v = F.col("embedding")
    return rounded(vectors(spark, folder).select("id", V.norm(v).alias("length"), V.mean(v).alias("mean"), V.std(v).alias("std"), V.sparsity(v).alias("sparsity")), "length", "mean", "std", "sparsity")


def proj32_base64(spark, folder):
    return vectors(spark, folder).select("id", V.encoded_levels(V.grey_levels(F.col("embedding"))).alias("encoded"))


def queries():
    return {
        "proj8_minmax": _each(V.min_max),
        "proj9_meanstd": _each(lambda v: V.preset(v, "mean05std0225")),
        "proj10_channels": _each(lambda v: V.channels(v, 3)),
        "proj11_l2norm": _each(V.l2_normalised),
        "proj14_logstretch": _each(V.log_stretched),
        "proj15_log1p_finite": _each(lambda v: V.log1p_finite(F.transform(v, lambda x: x * 6))),
        "proj17_tokens": proj17_tokens,
        "proj30_standardise": _each(V.standardised),
        "proj32_grey_levels": _each(_scaled),
        "proj32_base64": proj32_base64,
        "proj10_resized": _each(lambda v: V.resized(v, F.lit(8), F.lit(8), 5, 12)),
        "v1_l2": _to_first(V.squared_l2),
        "v2_cos": _to_first(lambda a, b: V.distance(a, b, "cos")),
        "v5_norms": v5_norms,
        "v6_cosine": _to_first(V.cosine),
        "v7_inner": _to_first(V.dot),
        "v8_group_cosine": v8_group_cosine,
    }


def oracle_sql():
    return {
        "proj8_minmax": _each_sql(_MM),
        "proj9_meanstd": _each_sql("list_transform(v, lambda x: (x - 0.5) / 0.225)"),
        "proj10_channels": _each_sql("list_concat(list_concat(v, v), v)"),
        "proj11_l2norm": _each_sql("list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))"),
        "proj14_logstretch": f"""WITH {VECTORS}, g AS (SELECT id, {_LOG} AS v FROM f), t AS (SELECT id, {_MM} AS y FROM g)
SELECT id, CAST(pos - 1 AS INT) AS pos, round(y[pos], 6) AS x FROM (SELECT id, y, unnest(range(1, len(y) + 1)) AS pos FROM t)""",
        "proj15_log1p_finite": f"""WITH {VECTORS},
g AS (SELECT id, list_transform(v, lambda x: CASE WHEN x * 6 > -1 THEN ln(1 + x * 6) END) AS l FROM f),
t AS (SELECT id, list_transform(l, lambda x: coalesce(x, list_min(list_filter(l, lambda y: y IS NOT NULL)))) AS y FROM g)
SELECT id, CAST(pos - 1 AS INT) AS pos, round(y[pos], 6) AS x FROM (SELECT id, y, unnest(range(1, len(y) + 1)) AS pos FROM t)""",
        "proj17_tokens": _each_sql("v[1:8]"),
        "proj30_standardise": _each_sql("list_transform(v, lambda x: (x - list_avg(v)) / (list_stddev_pop(v) + 1e-6))"),
        "proj32_base64": f"""WITH {VECTORS}, t AS (SELECT id, list_transform({_MM}, lambda x: CAST(floor(x * 255) AS INT)) AS g FROM f)
SELECT id, to_base64(unhex(list_aggregate(list_transform(g, lambda x: lpad(hex(x), 2, '0')), 'string_agg', ''))) AS encoded FROM t""",
        "proj10_resized": f"""WITH {VECTORS}, rp AS (SELECT r, least(greatest((r + 0.5::DOUBLE) * 8 / 5 - 0.5, 0), 7) AS at FROM range(5) t(r)), cp AS (SELECT c, least(greatest((c + 0.5::DOUBLE) * 8 / 12 - 0.5, 0), 7) AS at FROM range(12) t(c)),
g AS (SELECT r * 12 + c AS pos, CAST(floor(rp.at) AS INT) AS r0, CAST(least(floor(rp.at) + 1, 7) AS INT) AS r1, rp.at - floor(rp.at) AS pr, CAST(floor(cp.at) AS INT) AS c0, CAST(least(floor(cp.at) + 1, 7) AS INT) AS c1, cp.at - floor(cp.at) AS pc FROM rp, cp)
SELECT id, CAST(pos AS INT) AS pos, round((v[r0 * 8 + c0 + 1] * (1 - pc) + v[r0 * 8 + c1 + 1] * pc) * (1 - pr) + (v[r1 * 8 + c0 + 1] * (1 - pc) + v[r1 * 8 + c1 + 1] * pc) * pr, 6) AS x FROM f, g""",
        "proj32_grey_levels": _each_sql(f"list_transform({_MM}, lambda x: CAST(floor(x * 255) AS DOUBLE))"),
        "v1_l2": _to_first_sql("list_sum(list_transform(range(1, 65), lambda i: (v[i] - q[i]) * (v[i] - q[i])))"),
        "v2_cos": _to_first_sql("2 - 2 * list_inner_product(v, q)"),
        "v5_norms": f"""WITH {VECTORS} SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS length, round(list_avg(v), 6) AS mean,
round(list_stddev_pop(v), 6) AS std, round(len(list_filter(v, lambda x: x = 0)) / len(v), 6) AS sparsity FROM f""",
        "v6_cosine": _to_first_sql("list_cosine_similarity(v, q)"),
        "v7_inner": _to_first_sql("list_inner_product(v, q)"),
        "v8_group_cosine": f"""WITH {VECTORS}, l AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM f),
a AS (SELECT label, pos, avg(x) AS x FROM l GROUP BY ALL), g AS (SELECT label, list(x ORDER BY pos) AS c FROM a GROUP BY label)
SELECT g.label AS group_a, h.label AS group_b, round(list_cosine_similarity(g.c, h.c), 6) AS similarity FROM g, g AS h""",
    }
