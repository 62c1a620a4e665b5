"""Hierarchies of clusters as an edge table (rows J10-J12, J17, W4, A5, A14, A21).

``edges`` has (level, parent_id, child_id): at level 1 the children are points, above them clusters of the
level below.  ``nodes`` has (level, cluster_id) of every cluster, empty ones too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def flattened(edges: DataFrame, levels: int) -> DataFrame:
    """(level, cluster_id, id), the points under each cluster of each level."""
    flat = edges.where("level = 1").select(F.lit(1).alias("level"), F.col("parent_id").alias("cluster_id"), F.col("child_id").alias("id"))
    out = flat
    for level in range(2, levels + 1):
        up = edges.where(F.col("level") == level).select("parent_id", "child_id")
        flat = flat.join(up, flat["cluster_id"] == up["child_id"]).select(F.lit(level).alias("level"), F.col("parent_id").alias("cluster_id"), "id")
        out = out.unionAll(flat)
    return out


def traced(edges: DataFrame, levels: int) -> DataFrame:
    """(id, level_1, ..., level_n), the cluster of each point at each level."""
    out = edges.where("level = 1").select(F.col("child_id").alias("id"), F.col("parent_id").alias("level_1"))
    for level in range(2, levels + 1):
        up = edges.where(F.col("level") == level).select(F.col("child_id").alias(f"level_{level - 1}"), F.col("parent_id").alias(f"level_{level}"))
        out = out.join(up, f"level_{level - 1}")
    return out.select("id", *(f"level_{n}" for n in range(1, levels + 1)))


def sizes(edges: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """A5: (level, cluster_id, children, flat_size) of every cluster, from the bottom up by sums."""
    counts = edges.groupBy("level", "parent_id").agg(F.count("*").alias("children"))
    counts = nodes.join(counts, (nodes["level"] == counts["level"]) & (nodes["cluster_id"] == counts["parent_id"]), "left").select(
        nodes["level"], nodes["cluster_id"], F.coalesce("children", F.lit(0)).alias("children")
    )
    below = counts.where("level = 1").select("level", "cluster_id", "children", F.col("children").alias("flat_size"))
    out = below
    for level in range(2, levels + 1):
        up = edges.where(F.col("level") == level)
        sums = up.join(below, up["child_id"] == below["cluster_id"]).groupBy("parent_id").agg(F.sum("flat_size").alias("flat_size"))
        own = counts.where(F.col("level") == level)
        below = own.join(sums, own["cluster_id"] == sums["parent_id"], "left").select(
            "level", "cluster_id", "children", F.coalesce("flat_size", F.lit(0)).alias("flat_size")
        )
        out = out.unionAll(below)
    return out


def size_order(sized: DataFrame) -> DataFrame:
    """Place of each cluster of a level by descending size, ties by descending id."""
    w = W.partitionBy("level")
    return sized.select(
        "level",
        "cluster_id",
        F.row_number().over(w.orderBy(F.desc("children"), F.desc("cluster_id"))).alias("size_place"),
        F.row_number().over(w.orderBy(F.desc("flat_size"), F.desc("cluster_id"))).alias("flat_place"),
    )


def level_sizes(sized: DataFrame) -> DataFrame:
    """Mean and greatest number of children for each level."""
    return sized.groupBy("level").agg(F.avg("children").alias("mean_size"), F.max("children").alias("max_size"))


def positions(lists: DataFrame) -> DataFrame:
    """(id, cluster_id, cluster_size, position) from lists of members."""
    return lists.select("cluster_id", F.size("members").alias("cluster_size"), F.posexplode("members").alias("position", "id")).select(
        "id", "cluster_id", "cluster_size", "position"
    )
