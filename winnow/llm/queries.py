"""Queries of the operators for training data, over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from winnow.functions.lineage import cut
from winnow.llm import clusters, encoding, leaks, near_duplicates, neighbours, text_quality, varied

Query = Callable[[SparkSession, str], DataFrame]

#: Where the public vocabularies are; a parameter of the operators.
TOKENIZERS = "/opt/tokenizers"


def p1_subsets(spark: SparkSession, folder: str) -> DataFrame:
    features = spark.read.parquet(f"{folder}/features.parquet")
    cutouts = spark.read.parquet(f"{folder}/cutouts.parquet")
    requests = spark.read.parquet(f"{folder}/sample_requests.parquet")
    return varied.varied_subset(features, cutouts, requests)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    features = spark.read.parquet(f"{folder}/features.parquet")
    return neighbours.similar_pairs(neighbours.most_similar(features, k=5, floor=0.82, config=neighbours.ALIKE))


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar cutouts of every cutout, whatever their similarity."""
    return neighbours.most_similar(spark.read.parquet(f"{folder}/features.parquet"), k=5)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    features = spark.read.parquet(f"{folder}/features.parquet")
    return clusters.level_clusters(features, floor=0.82, least=5).select("cluster_id", "id")


def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Size, members and most typical members of the density clusters."""
    return clusters.density_clusters(spark.read.parquet(f"{folder}/features.parquet"), least=5, neighbours=5)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    features = spark.read.parquet(f"{folder}/features.parquet")
    cutouts = spark.read.parquet(f"{folder}/cutouts.parquet")
    pairs = near_duplicates.near_pairs(features, floor=0.98)
    return near_duplicates.compatible_pairs(pairs, cutouts, apart=64).select("id_a", "id_b")


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate group of every cutout that has one, and its number of links."""
    features = spark.read.parquet(f"{folder}/features.parquet")
    cutouts = spark.read.parquet(f"{folder}/cutouts.parquet")
    pairs = near_duplicates.compatible_pairs(cut(near_duplicates.near_pairs(features, floor=0.98)), cutouts, apart=64)
    return near_duplicates.groups(cut(pairs))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return encoding.encode(documents, str(Path(TOKENIZERS, "byte_bpe_50k.tiktoken")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/eval_items.parquet")
    return leaks.leaks(documents, items, passage=13).select("doc_id", "item_id")


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """All statistics of every document, with its percentiles and robust scores in its language."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    common = spark.read.parquet(f"{folder}/common_words.parquet")
    return text_quality.standing(cut(text_quality.statistics(documents, common)))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    common = spark.read.parquet(f"{folder}/common_words.parquet")
    stats = cut(text_quality.statistics(documents, common))
    return text_quality.lower_tail(stats, "prose_words").select("doc_id")


def queries() -> dict[str, Query]:
    all_ = (p1_subsets, p2_found, p2_neighbours, p3_found, p3_clusters, p4_found, p4_groups, p6_ids, p7_found, p8_found, p8_statistics)
    return {q.__name__: q for q in all_}


#: Usable vectors, one row for each id.
_USABLE = """u AS MATERIALIZED (SELECT id, CAST(list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS DOUBLE[64]) AS v FROM features
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
QUALIFY row_number() OVER (PARTITION BY id ORDER BY extracted_at) = 1)"""


def _pairs(floor: float) -> str:
    """All pairs of at least ``floor``, by comparing all vectors."""
    return f"pr AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id < b.id WHERE array_cosine_similarity(a.v, b.v) >= {floor})"


#: The smallest id that each id reaches over pairs.
_REACHED = """e AS MATERIALIZED (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr),
r AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
c AS (SELECT id, min(root) AS root FROM r GROUP BY 1)"""

#: The pairs that neither name nor position contradicts.
_COMPATIBLE = """k AS (SELECT id, nullif(regexp_extract(mosaic_name, '(?:^|[^0-9])([0-9]{5})(?:[^0-9]|$)', 1), '') AS m,
CASE WHEN len("position") = 2 AND "position"[1] IS NOT NULL AND "position"[2] IS NOT NULL THEN "position" END AS p FROM cutouts QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1),
pr AS MATERIALIZED (SELECT a, b FROM near LEFT JOIN k x ON x.id = a LEFT JOIN k y ON y.id = b WHERE NOT coalesce(x.m <> y.m, false)
AND NOT coalesce(abs(CAST(x.p[1] AS BIGINT) - y.p[1]) > 64 OR abs(CAST(x.p[2] AS BIGINT) - y.p[2]) > 64, false))"""


def oracle_sql() -> dict[str, str]:
    """Brute force over all pairs.  p2_found is a search with few misses; its leaves are whole tables up to 4,096
    vectors, so there it finds all."""
    near = _pairs(0.98).replace("pr AS", "near AS", 1)
    return {
        "p2_found": f"""WITH {_USABLE}, s AS (SELECT a.id AS a, b.id AS b, round(array_cosine_similarity(a.v, b.v), 6) AS s FROM u a JOIN u b ON a.id <> b.id WHERE array_cosine_similarity(a.v, b.v) >= 0.82),
t AS (SELECT a, b FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5) SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM t""",
        "p3_found": f"""WITH RECURSIVE {_USABLE}, {_pairs(0.82)}, {_REACHED}
SELECT root AS cluster_id, id FROM c WHERE root IN (SELECT root FROM c GROUP BY 1 HAVING count(*) >= 5)""",
        "p4_found": f"WITH {_USABLE}, {near}, {_COMPATIBLE} SELECT a AS id_a, b AS id_b FROM pr",
        "p4_groups": f"""WITH RECURSIVE {_USABLE}, {near}, {_COMPATIBLE}, {_REACHED}
SELECT c.id, c.root AS group_id, count(*) AS links FROM c JOIN e ON e.a = c.id GROUP BY 1, 2""",
    }
