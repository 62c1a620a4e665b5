"""Tables that several queries start from, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.operators.vectors import doubles


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(id, embedding, label) of the embeddings, in double precision."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), doubles(F.col("embedding")).alias("embedding"), "label")


VECTORS = "f AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def cutouts(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each cutout, its mosaic as five digits, its position as two numbers or nulls."""
    p = F.col("position")
    complete = p.isNotNull() & (F.size(p) == 2)
    return (
        table(spark, folder, "cutouts")
        .select(
            "id",
            "file_path",
            "survey",
            F.nullif(F.regexp_extract("mosaic_name", "([0-9]{5})", 1), F.lit("")).alias("mosaic_name"),
            F.when(complete, F.get(p, F.lit(0))).alias("pos_row"),
            F.when(complete, F.get(p, F.lit(1))).alias("pos_col"),
            "size",
            "cutout_run",
        )
        .dropDuplicates(["id"])
    )


CUTOUTS = """c AS (
  SELECT id, file_path, survey, nullif(regexp_extract(mosaic_name, '([0-9]{5})', 1), '') AS mosaic_name,
    CASE WHEN len("position") = 2 THEN "position"[1] END AS pos_row,
    CASE WHEN len("position") = 2 THEN "position"[2] END AS pos_col, size, cutout_run
  FROM cutouts QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)"""


def features(spark: SparkSession, folder: str) -> DataFrame:
    """(id, embedding) of the cutouts' usable vectors, one row for each id."""
    e = doubles(F.col("embedding"))
    usable = (
        (F.size(e) == 64)
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(e, lambda x: x != 0)
    )
    return table(spark, folder, "features").where(usable).select("id", e.alias("embedding")).dropDuplicates(["id"])


FEATURES = """u AS (
  SELECT id, CAST(embedding AS DOUBLE[]) AS v FROM features
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY extracted_at) = 1)"""


def small_mosaics(spark: SparkSession, folder: str) -> DataFrame:
    """One small mosaic for each nation."""
    return table(spark, folder, "nation").select(
        F.col("n_name").alias("mosaic_name"),
        F.col("n_nationkey").alias("k"),
        (16 + 4 * (F.col("n_nationkey") % 4)).cast("int").alias("height"),
        (20 + 4 * (F.col("n_nationkey") % 3)).cast("int").alias("width"),
    )


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(mosaic_name, row, col, value) of every pixel of the small mosaics; some are blank."""
    cells = small_mosaics(spark, folder).select(
        "mosaic_name", "k", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row")
    ).select("mosaic_name", "k", "row", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "k", "row", "col")), 1, 8), 16, 10).cast("long")
    return cells.select("mosaic_name", "row", "col", F.when(h % 32 != 0, h / float(1 << 32)).alias("value"))


PIXELS = """m AS (SELECT n_name AS mosaic_name, n_nationkey AS k, CAST(16 + 4 * (n_nationkey % 4) AS INT) AS height,
    CAST(20 + 4 * (n_nationkey % 3) AS INT) AS width FROM nation),
px0 AS (SELECT mosaic_name, k, width, unnest(range(0, height)) AS r FROM m),
px1 AS (SELECT mosaic_name, k, r, unnest(range(0, width)) AS c FROM px0),
px2 AS (SELECT mosaic_name, r AS "row", c AS "col", CAST('0x' || substr(md5(concat_ws('|', k, r, c)), 1, 8) AS BIGINT) AS h FROM px1),
px AS (SELECT mosaic_name, "row", "col", CASE WHEN h % 32 <> 0 THEN h / 4294967296.0::DOUBLE END AS value FROM px2)"""


def tree(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of a hierarchy of orders, customers, nations and regions.

    Points are the orders in work, in the order of their price; customers without one are empty clusters.
    """
    from pyspark.sql import Window as W

    orders = table(spark, folder, "orders").where("o_orderstatus = 'P'")
    w = W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    one = orders.select(
        F.lit(1).alias("level"), F.col("o_custkey").cast("long").alias("parent_id"), F.col("o_orderkey").cast("long").alias("child_id"), F.row_number().over(w).alias("rank_in_cluster")
    )
    two = table(spark, folder, "customer").select(F.lit(2).alias("level"), F.col("c_nationkey").cast("long").alias("parent_id"), F.col("c_custkey").cast("long").alias("child_id"))
    three = table(spark, folder, "nation").select(F.lit(3).alias("level"), F.col("n_regionkey").cast("long").alias("parent_id"), F.col("n_nationkey").cast("long").alias("child_id"))
    edges = one.unionByName(two, allowMissingColumns=True).unionByName(three, allowMissingColumns=True)
    nodes = (
        two.select(F.lit(1).alias("level"), F.col("child_id").alias("cluster_id"))
        .unionAll(three.select(F.lit(2), "child_id"))
        .unionAll(table(spark, folder, "region").select(F.lit(3), F.col("r_regionkey").cast("long")))
    )
    return edges, nodes


TREE = """e AS (
  SELECT 1 AS level, CAST(o_custkey AS BIGINT) AS parent_id, CAST(o_orderkey AS BIGINT) AS child_id,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rank_in_cluster
  FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT 2, CAST(c_nationkey AS BIGINT), CAST(c_custkey AS BIGINT), NULL FROM customer
  UNION ALL SELECT 3, CAST(n_regionkey AS BIGINT), CAST(n_nationkey AS BIGINT), NULL FROM nation),
n AS (SELECT 1 AS level, CAST(c_custkey AS BIGINT) AS cluster_id FROM customer
  UNION ALL SELECT 2, CAST(n_nationkey AS BIGINT) FROM nation UNION ALL SELECT 3, CAST(r_regionkey AS BIGINT) FROM region),
f1 AS (SELECT n.cluster_id, count(e.child_id) AS children, count(e.child_id) AS flat_size
  FROM n LEFT JOIN e ON e.level = 1 AND e.parent_id = n.cluster_id WHERE n.level = 1 GROUP BY 1),
f2 AS (SELECT n.cluster_id, count(e.child_id) AS children, CAST(coalesce(sum(f1.flat_size), 0) AS BIGINT) AS flat_size
  FROM n LEFT JOIN e ON e.level = 2 AND e.parent_id = n.cluster_id LEFT JOIN f1 ON f1.cluster_id = e.child_id WHERE n.level = 2 GROUP BY 1),
f3 AS (SELECT n.cluster_id, count(e.child_id) AS children, CAST(coalesce(sum(f2.flat_size), 0) AS BIGINT) AS flat_size
  FROM n LEFT JOIN e ON e.level = 3 AND e.parent_id = n.cluster_id LEFT JOIN f2 ON f2.cluster_id = e.child_id WHERE n.level = 3 GROUP BY 1),
s AS (SELECT 1 AS level, * FROM f1 UNION ALL SELECT 2, * FROM f2 UNION ALL SELECT 3, * FROM f3)"""


def two_sets(spark: SparkSession, folder: str) -> DataFrame:
    """(side, value) of two kinds of events."""
    side = F.when(F.col("event_type") == "click", "a").when(F.col("event_type") == "view", "b")
    return table(spark, folder, "events").select(side.alias("side"), "value").where("side is not null and value is not null")


SETS = """w AS (SELECT CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' END AS side, value FROM events
  WHERE event_type IN ('click', 'view') AND value IS NOT NULL)"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})
