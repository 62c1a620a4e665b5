"""The condensed hierarchy of a spanning forest, merged edge by edge over tasks of a bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.lineage import cut
from winnow.llm.components import components
from winnow.llm.spanning import SCALE

STATE = "node long, cluster long, size long, total double, best double"
EVENTS = "kind int, x long, y long, size long, total double, best double, end double"
#: Kinds of events: the state of a component after a band, a small component that joins a cluster, a cluster that ends.
NOW, JOIN, END = 0, 1, 2


def condensed(forest: DataFrame, roots: DataFrame, least: int, far: int, task_edges: int) -> tuple[DataFrame, DataFrame]:
    """((id, cluster, density), (cluster, parent, stable, best, end)) of a minimum spanning forest.

    ``forest`` has (a, b, w), ``roots`` the tree (id, root) of every vertex.  density is that at which the vertex
    came to its first cluster, end the density at which a cluster ends, stable its stability and best the
    sum over its children of what the better of child and its descendants is worth.  All merges are exact.

    Trees of at most ``task_edges`` edges are merged in one go, many in a task.  Where the largest has more,
    the distances are divided into bands in which no tree has about more than that, band after band: a
    component of one band is a node of the next, and what its merging left is handed on.
    """
    spark = forest.sparkSession
    points = roots.select("id", F.col("id").alias("node"), "root")
    own = forest.join(roots.select(F.col("id").alias("a"), "root"), "a").select("a", "b", "w", "root")
    own = cut(own)
    sizes = own.groupBy("root").agg(F.count("*").alias("n"))
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    count = max(1, -(-largest // task_edges))
    bounds = [far]
    if count > 1:
        large = own.join(sizes.where(F.col("n") > task_edges).select("root"), "root", "left_semi")
        shares = [k / (2 * count) for k in range(1, 2 * count)]
        bounds = sorted({*large.agg(F.percentile_approx("w", shares, 10_000).alias("q")).first()["q"], far})
    bins = max(1, -(-2 * total // task_edges), spark.sparkContext.defaultParallelism)
    state: DataFrame | None = None
    joins: DataFrame | None = None
    ends: DataFrame | None = None
    for at, bound in enumerate(bounds):
        low = bounds[at - 1] if at else -1
        last = at == len(bounds) - 1
        band = own.where((F.col("w") > low) & (F.col("w") <= bound))
        if at:
            a, b = (points.select(F.col("id").alias(x), F.col("node").alias(f"n{x}")) for x in "ab")
            band = band.join(a, "a").join(b, "b")
        else:
            band = band.withColumns({"na": F.col("a"), "nb": F.col("b")})
        if last:
            groups = cut(points.select("node", F.col("root").alias("group")).distinct()) if at else None
            band = band.withColumn("group", F.col("root"))
        else:
            band = cut(band)
            groups = cut(components(band, "na", "nb").withColumnRenamed("root", "group"))
            band = band.join(groups.select(F.col("node").alias("na"), "group"), "na")
        bin_ = F.pmod(F.xxhash64("group"), F.lit(bins)).alias("bin")
        left = band.select(bin_, "group", "na", "nb", "w", "a", "b")
        if state is None:
            right = spark.createDataFrame([], f"own_bin long, own_group long, {STATE}")
        else:
            right = state.join(groups, "node").select(bin_.alias("own_bin"), F.col("group").alias("own_group"), *(c.split()[0] for c in STATE.split(", ")))
        work = _merging(least, SCALE / far if last else 0.0)
        events = cut(left.groupBy("bin").cogroup(right.groupBy("own_bin")).applyInArrow(work, EVENTS))
        came = events.where(F.col("kind") == JOIN).select(F.col("x").alias("node"), F.col("y").alias("cluster"), F.col("total").alias("density"))
        came = points.join(came, "node").select("id", "cluster", "density")
        joins = came if joins is None else joins.unionAll(came)
        over = events.where(F.col("kind") == END).select(F.col("x").alias("cluster"), F.col("y").alias("parent"), F.col("total").alias("stable"), "best", "end")
        ends = over if ends is None else ends.unionAll(over)
        if not last:
            now = events.where(F.col("kind") == NOW).select(F.col("x").alias("node"), F.col("y").alias("cluster"), "size", "total", "best")
            if state is not None:
                now = now.unionAll(state.join(groups.select("node"), "node", "left_anti"))
            state = cut(now)
            moved = points.join(groups, "node", "left").select("id", F.coalesce("group", "node").alias("node"), "root")
            points = cut(moved)
    return cut(joins), cut(ends)


def _name(a: int, b: int) -> int:
    """A name for the cluster that begins with the edge (a, b); different edges get different ones, but for the
    chance of a collision of 63 bits."""
    z = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & (2**64 - 1)
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return (z ^ (z >> 31)) >> 1


def _merging(least: int, floor: float):
    """Merges the edges of each group, lightest first.  ``floor`` is the density at which the clusters that are
    left end, 0 if they go on in the next band."""

    def work(edges: pa.Table, states: pa.Table) -> pa.Table:
        group, na, nb, w, a, b = (edges.column(c).to_numpy() for c in ("group", "na", "nb", "w", "a", "b"))
        order = np.lexsort((b, a, w))
        nodes = np.unique(np.r_[na, nb, states.column("node").to_numpy()]).astype(np.int64)
        n = len(nodes)
        up = list(range(n))
        size, cluster, total, best = [1] * n, [-1] * n, [0.0] * n, [0.0] * n
        home = [0] * n
        for row in states.to_pylist():
            k = int(np.searchsorted(nodes, row["node"]))
            size[k], cluster[k], total[k], best[k], home[k] = row["size"], row["cluster"], row["total"], row["best"], row["own_group"]
        out: list[tuple] = []
        who: list[int] = []  # nodes that join, with the clusters, the numbers of nodes and the densities of the joins
        came: list[tuple[int, int, float]] = []
        waiting: list[list[int]] = [[k] if cluster[k] < 0 else [] for k in range(n)]  # nodes of a small component

        def find(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        def close(k: int, parent: int, density: float) -> float:
            stable = total[k] - size[k] * density
            out.append((END, cluster[k], parent, size[k], stable, best[k], density))
            return max(stable, best[k])

        ends = (np.searchsorted(nodes, c) for c in (na, nb))
        for g, p, q, d, e, f in zip(*(c[order].tolist() for c in (group, *ends, w, a, b)), strict=True):
            i, j = find(p), find(q)
            if i == j:
                continue
            if size[i] < size[j]:
                i, j = j, i
            density = SCALE / max(1, d)
            if cluster[i] >= 0 and cluster[j] >= 0:
                parent = _name(e, f)
                worth = close(i, parent, density) + close(j, parent, density)
                cluster[i], total[i], best[i] = parent, (size[i] + size[j]) * density, worth
            elif cluster[i] >= 0:
                total[i] += size[j] * density
                who += waiting[j]
                came.append((cluster[i], len(waiting[j]), density))
            else:
                waiting[i] += waiting[j]
                if size[i] + size[j] >= least:
                    cluster[i], total[i] = _name(e, f), (size[i] + size[j]) * density
                    who += waiting[i]
                    came.append((cluster[i], len(waiting[i]), density))
                    waiting[i] = []
            waiting[j] = []
            size[i] += size[j]
            up[j] = i
            home[i] = g
        for k in range(n):
            if up[k] == k:
                if floor and cluster[k] >= 0:
                    close(k, -1, floor)
                elif not floor:
                    out.append((NOW, home[k], cluster[k], size[k], total[k], best[k], 0.0))
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in EVENTS.split(", ")]
        events = pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
        to, many, density = zip(*came, strict=True) if came else ((), (), ())
        many, none = np.array(many, np.int64), np.zeros(len(who))
        joined = (np.full(len(who), JOIN), nodes[np.array(who, np.int64)], np.repeat(np.array(to, np.int64), many), none, np.repeat(np.array(density, float), many), none, none)
        return pa.concat_tables([events, pa.table([pa.array(c).cast(t) for c, t in zip(joined, kinds, strict=True)], names=names)])

    return work


def topmost(tree: DataFrame) -> DataFrame:
    """(cluster, taken, end): for each cluster the highest of it and its ancestors that is worth as much as its
    descendants, and the density at which that one ends; clusters without one are left out.

    Found by doubling pointers: after a step each cluster knows the highest among twice as many ancestors."""
    wins = F.when(F.col("stable") >= F.col("best"), F.struct(F.col("cluster").alias("taken"), "end"))
    now = cut(tree.select("cluster", F.col("parent").alias("up"), wins.alias("top")))
    while not now.where("up >= 0").isEmpty():
        above = now.select(F.col("cluster").alias("up"), F.col("up").alias("upper"), F.col("top").alias("higher"))
        now = cut(now.join(above, "up", "left").select("cluster", F.coalesce("upper", F.lit(-1)).alias("up"), F.coalesce("higher", "top").alias("top")))
    return now.where("top is not null").select("cluster", "top.taken", "top.end")
