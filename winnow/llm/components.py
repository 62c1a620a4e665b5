"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.lineage import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges; root is the smallest node of its component.

    Alternates two steps until nothing changes: every node hands its larger neighbours, then its
    smaller ones, to the smallest node it knows.  Both are an aggregation with partial results and a
    join, so a node with a third of all edges is no single group.  Null ends are ignored; loops and
    repeated edges don't matter.
    """
    e = cut(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    state = _state(e)
    while state[0]:
        now = _closer(e)
        before, state, e = state, _state(now), now
        if state == before:
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionAll(e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root")))


def _closer(e: DataFrame) -> DataFrame:
    """Both steps once; each reads its input several times, so it is cut."""
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = cut(large.unionAll(low.where("u > m").select("u", F.col("m").alias("v"))).distinct())
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return cut(small.unionAll(down.select("u", F.col("m").alias("v"))).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and a sum of their hashes; equal only if the edges are."""
    n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return n, int(total or 0)
