"""Queries on exact neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.operators import retrieval as R
from winnow.plans.common import VECTORS, rounded, vectors


def q1_knn_l2(spark, folder):
    v = vectors(spark, folder)
    return rounded(R.knn(v, v, 5, "l2"), "distance")


def q1_knn_cos(spark, folder):
    v = vectors(spark, folder)
    return rounded(R.knn(v, v, 5, "cos"), "distance")


def q3_search(spark, folder):
    v = vectors(spark, folder)
    return rounded(R.knn(v, v.where("id < 1000"), 10, "l2", itself=True), "distance")


def q4_retrieve(spark, folder):
    return rounded(R.similar_to(vectors(spark, folder), 3, 10), "similarity")


def q5_multi_query(spark, folder):
    v = vectors(spark, folder)
    queries = v.where("id % 100 = 0")
    return rounded(R.knn(v, queries, 8, "cos"), "distance")


def s19_normalised_table(spark, folder):
    return rounded(R.normalised_table(vectors(spark, folder)).select("id", F.posexplode("embedding").alias("pos", "x")), "x")


def queries():
    return {f.__name__: f for f in (q1_knn_l2, q1_knn_cos, q3_search, q4_retrieve, q5_multi_query, s19_normalised_table)}


def _knn_sql(queries: str, k: int, metric: str, itself: bool = False) -> str:
    d = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))))" if metric == "l2" else "1 - list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))"
    other = "true" if itself else "a.id <> b.id"
    return f"""WITH {VECTORS}, q AS ({queries}), p AS (SELECT a.id, b.id AS neighbor_id, {d} AS d FROM q a, f b WHERE {other}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY d, neighbor_id) AS INT) AS rank FROM p)
SELECT id, rank, neighbor_id, round(d, 6) AS distance FROM r WHERE rank <= {k}"""


def oracle_sql():
    return {
        "q1_knn_l2": _knn_sql("SELECT * FROM f", 5, "l2"),
        "q1_knn_cos": _knn_sql("SELECT * FROM f", 5, "cos"),
        "q3_search": _knn_sql("SELECT * FROM f WHERE id < 1000", 10, "l2", True),
        "q4_retrieve": f"""WITH {VECTORS} SELECT a.id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM f a, f b WHERE b.id = 3 AND a.id <> 3
ORDER BY list_cosine_similarity(a.v, b.v) DESC, a.id LIMIT 10""",
        "q5_multi_query": _knn_sql("SELECT * FROM f WHERE id % 100 = 0", 8, "cos"),
        "s19_normalised_table": f"""WITH {VECTORS}, t AS (SELECT id, unnest(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))) AS x, generate_subscripts(v, 1) - 1 AS pos FROM f)
SELECT id, CAST(pos AS INT) AS pos, round(x, 6) AS x FROM t""",
    }
