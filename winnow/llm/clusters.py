"""Grouping records into similarity clusters (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.functions.lineage import cut
from winnow.llm.buckets import Index, compared, fitted, of_heavy
from winnow.llm.components import components
from winnow.llm.forest import ForestConfig
from winnow.llm.hierarchy import condensed, topmost
from winnow.llm.kernels import ranked
from winnow.llm.neighbours import MERGE_IDS
from winnow.llm.packs import mix, pack, packed, regroup, unit, unpack, unpack_all
from winnow.llm.spanning import SCALE, followed, minimum_forest, spanning_forest

CONFIG = ForestConfig(step=0.4)
#: For links between groups, which are long: every vector is near many planes then.
WIDE = ForestConfig(step=0.4, miss=0.3)
#: Nearest neighbours of a vector that are edges of the graph.
NEAREST = 8
EDGES = "a long, b long, w long"


def reachability_graph(
    df: DataFrame, neighbours: int, floor: float, config: ForestConfig = CONFIG, ids: str = "id", vectors: str = "embedding"
) -> DataFrame:
    """(a, b, w), a < b: edges of the mutual-reachability graph, w in parts of 1 / SCALE.

    The edges are, from each leaf of the forest of random-projection trees, a minimum spanning forest of the
    pairs of at least ``floor`` compared there, and with ``neighbours`` > 0 the NEAREST most similar vectors of
    each vector over all its leaves.  w is the largest of the distance 1 - cosine and the cores of both ends;
    a core is the distance to the ``neighbours``-th most similar vector over all leaves, 0 for
    ``neighbours`` = 0, where an edge that a leaf left out closes a circle of lighter ones.  A vector
    with fewer neighbours has the distance at the floor as its core.
    """
    step = float(np.sqrt(max(0.0, 2 - 2 * floor)))
    config = replace(config, step=max(config.step, step))  # links between groups are as long as the floor allows
    index = fitted(df, config, ids, vectors, max(NEAREST, neighbours) + 1)
    edges = _compared_edges(df, index, neighbours, floor, ids, vectors)
    more = _copied_edges(df, index, ids, vectors)
    return edges if more is None else edges.unionAll(more)


def _copied_edges(df: DataFrame, index: Index, ids: str, vectors: str) -> DataFrame | None:
    """(a, b, w) from the smallest id of each heavy vector, a, to its copies that take no part in the forest of trees."""

    def copies(i: np.ndarray, firsts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(firsts[:, 0]), pa.array(i), pa.array(np.zeros(len(i), np.int64))], names=["a", "b", "w"])

    return of_heavy(df, index, copies, EDGES, ids, vectors)


def _compared_edges(df: DataFrame, index: Index, neighbours: int, floor: float, ids: str, vectors: str) -> DataFrame:
    """The edges of :func:`reachability_graph` between the vectors that take part in the forest of trees."""
    far = SCALE - round(floor * SCALE)

    def sorted_ends(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> list[pa.Array]:
        return [pa.array(c) for c in (np.minimum(a, b), np.maximum(a, b), w)]

    if neighbours <= 0:

        def work(i: np.ndarray, x: np.ndarray, home: np.ndarray) -> pa.Table:
            u, v, w = spanning_forest(unit(x), home, floor, NEAREST // 2)[1]
            return pa.Table.from_arrays(sorted_ends(i[u], i[v], w), names=["a", "b", "w"])

        return compared(df, index, work, EDGES, ids, vectors)

    parts = max(1, -(-index.rows // MERGE_IDS))
    k = max(NEAREST, neighbours)

    def search(i: np.ndarray, x: np.ndarray, home: np.ndarray) -> pa.Table:
        lists, forest, _ = spanning_forest(unit(x), home, floor, k)
        a, b, w = (np.r_[p, q] for p, q in zip(lists, forest, strict=True))
        kind = np.r_[np.zeros(len(lists[0]), np.int8), np.ones(len(forest[0]), np.int8)]
        a, b = i[a], i[b]
        task = (mix(a, 1) % np.uint64(parts)).astype(np.int64)
        return pa.Table.from_batches([packed(task, [a, b, w, kind])])

    def merge(table: pa.Table) -> pa.Table:
        kinds = [(np.int64, 0), (np.int64, 0), (np.int64, 0), (np.int8, 0)]
        a, b, w, kind = unpack_all(table.column("pack"), kinds)
        near = np.flatnonzero(kind == 0)
        keep = near[ranked(a[near], b[near], -w[near], k)]
        start = np.flatnonzero(np.r_[True, a[keep][1:] != a[keep][:-1]]) if len(keep) else keep
        size = np.diff(np.r_[start, len(keep)])
        nth = keep[start + np.minimum(size, neighbours) - 1]
        core = np.where(size >= neighbours, w[nth], far)
        known = a[nth]
        both = np.r_[keep, np.flatnonzero(kind == 1)]
        own = np.searchsorted(known, a[both])
        held = (own < len(known)) & (known[np.minimum(own, max(0, len(known) - 1))] == a[both]) if len(known) else np.zeros(len(both), bool)
        mine = np.full(len(both), far)
        mine[held] = core[own[held]]
        return pa.table({"pack": pa.array([pack(a[both], b[both], w[both], mine)], pa.binary())})

    def spread_out(parts_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_:
            for blob in batch.column(0):
                yield pa.RecordBatch.from_arrays(list(map(pa.array, unpack(blob.as_buffer().to_pybytes(), [(np.int64, 0)] * 4))), names=["a", "b", "d", "core"])

    def only_cores(parts_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spread_out(parts_):
            a, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(batch.column(3).to_numpy()[first])], names=["b", "other"])

    lists = compared(df, index, search, "task long, pack binary", ids, vectors)
    packs = cut(regroup(lists, parts, merge, "pack binary"))  # a fraction of the size of rows
    found = packs.mapInArrow(spread_out, "a long, b long, d long, core long")
    cores = packs.mapInArrow(only_cores, "b long, other long")  # a vector's lists are merged in one task
    weight = F.greatest("d", "core", F.coalesce("other", F.lit(far)))
    edges = found.join(cores, "b", "left").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), weight.alias("w")
    )
    return edges.groupBy("a", "b").agg(F.max("w").alias("w"))


def linked(
    df: DataFrame, floor: float, config: ForestConfig = CONFIG, ids: str = "id", vectors: str = "embedding"
) -> DataFrame:
    """(id, cluster_id) of every usable vector, lone ones too: what :func:`level_clusters` gives for ``least`` = 1,
    without its forest and hierarchy.

    With a core of one point the clusters are the trees of the minimum spanning forest up to the floor.  Borůvka's
    first rounds run in each leaf of the forest of
    random-projection trees; its components there are contracted to one vertex each, and as all that can
    still join them are the vectors that several leaves share, the last rounds are the components of a graph
    of contracted vertices.  cluster_id is the smallest id of the cluster; a vector without links is its
    own.

    Defined cases: as for :func:`winnow.llm.neighbours.most_similar`.
    """
    index = fitted(df, config, ids, vectors)
    schema = "id long, label long"

    def work(i: np.ndarray, x: np.ndarray, home: np.ndarray) -> pa.Table:
        comp = spanning_forest(unit(x), home, floor, 4)[2]  # named by its smallest row, and ids ascend
        joined = np.flatnonzero((np.bincount(comp, minlength=len(i))[comp] > 1) | home)
        return pa.table({"id": i[joined], "label": i[comp[joined]]})

    def copies(i: np.ndarray, firsts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(firsts[:, 0])], names=["id", "label"])

    found = compared(df, index, work, schema, ids, vectors)
    more = of_heavy(df, index, copies, schema, ids, vectors)
    found = found if more is None else found.unionAll(more)
    labels = cut(found.groupBy("id").agg(F.min("label").alias("label"), F.collect_set("label").alias("labels")))  # one a leaf
    ties = labels.where(F.size("labels") > 1).select("label", F.explode("labels").alias("other"))
    if more is not None:  # a copy's label is an id whose own label may be smaller
        own = labels.select(F.col("id").alias("label"), F.col("label").alias("other"))
        ties = ties.unionAll(own.join(more.select("label").distinct(), "label", "left_semi"))
    roots = components(ties.distinct(), "label", "other")
    return labels.join(roots, labels["label"] == roots["node"], "left").select("id", F.coalesce("root", "label").alias("cluster_id"))


def at_least(clusters: DataFrame, size: int) -> DataFrame:
    """The rows of clusters of at least ``size`` ids."""
    sizes = clusters.groupBy("cluster_id").count().where(F.col("count") >= size).select("cluster_id")
    return clusters.join(sizes, "cluster_id", "left_semi")


def level_clusters(
    df: DataFrame,
    floor: float,
    least: int = 5,
    task_edges: int = 500_000,
    config: ForestConfig = CONFIG,
    ids: str = "id",
    vectors: str = "embedding",
) -> DataFrame:
    """(id, cluster_id) of the members of the density hierarchy's clusters at similarity ``floor``.

    The steps are those of :func:`density_clusters` up to the hierarchy: the mutual-reachability graph, its minimum
    spanning forest and the merging edge by edge, with clusters of at least ``least`` vectors.  A core is of one
    vector, so mutual reachability is the distance itself; and the clusters are those alive at the floor, instead
    of the most stable ones.  cluster_id is the smallest id of the cluster.

    A vector in no cluster is no row.  Other cases as for :func:`winnow.llm.neighbours.most_similar`.
    """
    index = fitted(df, config, ids, vectors, max(NEAREST, least) + 1)
    forest, roots = minimum_forest(_compared_edges(df, index, 0, floor, ids, vectors), 2 * task_edges)
    if forest is None:
        return df.sparkSession.createDataFrame([], "id long, cluster_id long")
    joins, tree = condensed(forest, roots, least, SCALE - round(floor * SCALE), task_edges)
    up = F.when(F.col("parent") < 0, F.col("cluster")).otherwise(F.col("parent"))
    alive = followed(tree.select(F.col("cluster").alias("r"), up.alias("up")), task_edges)
    members = joins.join(alive.select(F.col("r").alias("cluster"), F.col("up").alias("taken")), "cluster").select("id", "taken")
    more = _copied_edges(df, index, ids, vectors)
    if more is not None:  # a copy is where the first of its vector is, which alone are enough for a cluster
        firsts = members.withColumnRenamed("id", "a")
        members = members.unionAll(more.select("a", "b").distinct().join(firsts, "a").select(F.col("b").alias("id"), "taken"))
    names = members.groupBy("taken").agg(F.min("id").alias("cluster_id"))
    return members.join(names, "taken").select("id", "cluster_id")


def density_clusters(
    df: DataFrame,
    least: int = 5,
    neighbours: int = 5,
    floor: float = 0.5,
    exemplars: int = 3,
    task_edges: int = 500_000,
    config: ForestConfig = WIDE,
    ids: str = "id",
    vectors: str = "embedding",
) -> DataFrame:
    """(id, cluster_id, size, persistence, exemplar) of the members of the density clusters.

    The minimum spanning forest of the mutual-reachability graph is merged edge by edge, lightest first
    (:func:`winnow.llm.hierarchy.condensed`).  A component that reaches ``least`` vectors is a cluster; one that
    meets a smaller component goes on, two that meet end, and a new one begins.  A cluster's stability
    is the sum over its vectors of the rise in density 1 / distance from its end to where they joined, and from
    below a cluster is taken instead of its descendants where its stability is at least theirs.  Everything
    ends at the distance of ``floor``.  persistence of a member is the rise in density from the cluster's
    end to where it joined, and the ``exemplars`` most persistent of a cluster, ties to the smaller id,
    are its exemplars.  cluster_id is the smallest id of the cluster.

    A vector in no taken cluster is no row.  Other cases as for :func:`winnow.llm.neighbours.most_similar`.
    """
    empty = "id long, cluster_id long, size long, persistence double, exemplar boolean"
    forest, roots = minimum_forest(reachability_graph(df, neighbours, floor, config, ids, vectors), 2 * task_edges)
    if forest is None:
        return df.sparkSession.createDataFrame([], empty)
    joins, tree = condensed(forest, roots, least, SCALE - round(floor * SCALE), task_edges)
    taken = topmost(tree)
    members = joins.join(taken, "cluster").select("id", F.col("taken").alias("cluster"), (F.col("density") - F.col("end")).alias("persistence"))
    members = cut(members)
    names = members.groupBy("cluster").agg(F.min("id").alias("cluster_id"), F.count("*").alias("size"))
    return _with_exemplars(members.join(names, "cluster").select("id", "cluster_id", "size", "persistence"), exemplars)


def _with_exemplars(members: DataFrame, exemplars: int) -> DataFrame:
    """The members with a mark at the most persistent of each cluster.  A bound for them comes from a partial
    aggregation, so that no cluster is sorted as a whole."""
    place = F.struct((-F.col("persistence")).alias("p"), "id")
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    w = W.partitionBy("cluster_id", "salt").orderBy(place)
    few = salted.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= exemplars)
    best = few.withColumn("rn", F.row_number().over(W.partitionBy("cluster_id").orderBy(place))).where(F.col("rn") <= exemplars)
    marks = best.select("id", F.lit(True).alias("exemplar"))
    return members.join(marks, "id", "left").select("id", "cluster_id", "size", "persistence", F.coalesce("exemplar", F.lit(False)).alias("exemplar"))
