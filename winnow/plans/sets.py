"""Queries on set operations and generated points."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.operators import sets as S
from winnow.operators.sampling import flat
from winnow.operators.statistics import pca
from winnow.plans.common import CUTOUTS, cutouts, rounded, table, vectors

CENTRES = [(0.0, 0.0), (6.0, 1.0), (-3.0, 5.0)]


def u2_tagged_union(spark, folder):
    c = cutouts(spark, folder)
    labelled = table(spark, folder, "annotations").select(F.trim("file_path").alias("file_path")).distinct()
    both = S.tagged_union(c.join(labelled, "file_path", "left_semi"), c.join(labelled, "file_path", "left_anti"))
    return both.select("id", "src")


def u5_seeds_and_neighbours(spark, folder):
    from winnow.plans.manifest import queries

    pairs = queries()["j5_neighbors8"](spark, folder)
    return S.with_neighbours(cutouts(spark, folder).where("survey is null").select("id"), pairs)


def u6_concatenated(spark, folder):
    ids = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    return S.concatenated(flat(ids, 200, 1), flat(ids, 300, 2))


def l8_first_batches(spark, folder):
    return S.first_batches(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), 32, 3, "o_orderdate", "o_orderkey")


def proj25_single_precision(spark, folder):
    v = vectors(spark, folder).select("id", F.posexplode(F.transform("embedding", lambda x: x / 3).cast("array<float>")).alias("pos", "x"))
    return rounded(v.withColumn("x", F.col("x").cast("double")), "x")


def proj27_mixture(spark, folder):
    return rounded(S.mixture(spark, [2000, 750, 200], CENTRES), "x", "y")


def proj27_rings(spark, folder):
    return rounded(S.rings(spark, [2000, 20, 100, 50, 800]), "x", "y")


def t4_pca16(spark, folder):
    v = vectors(spark, folder)
    return rounded(pca(v, v, 64, 16, scale=False).select("id", F.posexplode("pc").alias("axis", "x")), "x")


def queries():
    names = [u2_tagged_union, u5_seeds_and_neighbours, u6_concatenated, l8_first_batches, proj25_single_precision, proj27_mixture, proj27_rings, t4_pca16]
    return {f.__name__: f for f in names}


def _uniform(seed: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}|' || id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def _gaussian(seed: str) -> str:
    return f"sqrt(-2 * ln(1 - {_uniform(seed + '|u')})) * cos(2 * pi() * {_uniform(seed + '|v')})"


def oracle_sql():
    from winnow.plans import manifest

    parts = " UNION ALL ".join(
        f"SELECT id, {k} AS part, round({x} + {_gaussian(f'0|{k}|x')}, 6) AS x, round({y} + {_gaussian(f'0|{k}|y')}, 6) AS y FROM range({n}) r(id)"
        for k, (n, (x, y)) in enumerate(zip([2000, 750, 200], CENTRES, strict=True))
    )
    draw = "SELECT id FROM (SELECT o_orderkey AS id FROM orders ORDER BY md5(concat_ws('|', '{0}', o_orderkey)), o_orderkey LIMIT {1})"
    return {
        "u2_tagged_union": f"WITH {CUTOUTS} SELECT id, CASE WHEN file_path IN (SELECT trim(file_path) FROM annotations WHERE file_path IS NOT NULL) THEN 0 ELSE 1 END AS src FROM c",
        "u5_seeds_and_neighbours": f"""WITH {CUTOUTS}, j AS ({manifest.oracle_sql()["j5_neighbors8"]})
SELECT id FROM c WHERE survey IS NULL UNION SELECT neighbor_id FROM j WHERE id IN (SELECT id FROM c WHERE survey IS NULL)""",
        "u6_concatenated": f"{draw.format(1, 200)} UNION ALL {draw.format(2, 300)}",
        "l8_first_batches": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 96",
        "proj25_single_precision": """SELECT vec_id AS id, CAST(pos - 1 AS INT) AS pos, round(CAST(CAST(CAST(embedding[pos] AS DOUBLE) / 3 AS FLOAT) AS DOUBLE), 6) AS x
FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS pos FROM embeddings)""",
        "proj27_mixture": parts,
        "proj27_rings": f"""WITH p AS (SELECT id, CAST(id >= 2000 AS INT) + CAST(id >= 2020 AS INT) + CAST(id >= 2120 AS INT) + CAST(id >= 2170 AS INT) AS ring FROM range(2970) r(id)),
q AS (SELECT id, ring, ring + 1 + 0.1::DOUBLE * {_gaussian("0|radius")} AS r, 2 * pi() * {_uniform("0|angle")} AS a FROM p)
SELECT id, ring, round(r * cos(a), 6) AS x, round(r * sin(a), 6) AS y FROM q""",
    }
