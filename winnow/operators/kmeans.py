"""k-means as driver loops over distributed passes (rows K1-K9, K11-K13, A2-A7, W2, L3)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.functions.draws import draw_order, uniform
from winnow.functions.lineage import cut
from winnow.functions.order import numbered
from winnow.functions.partitions import small
from winnow.operators.blocks import assigned, matrix, nearest, partial_sums
from winnow.operators.pipeline import keep_steps, latest_step
from winnow.operators.vectors import doubles, l2, squared_l2


#: Centroids that each point is measured against by an expression.
EXPRESSION_CENTRES = 1_000


@dataclass(frozen=True)
class Centroids:
    """Centroid rows and their cluster ids, ascending."""

    ids: np.ndarray
    rows: np.ndarray

    def table(self, spark) -> DataFrame:
        data = [(int(i), [float(v) for v in r]) for i, r in zip(self.ids, self.rows, strict=True)]
        return spark.createDataFrame(data, "cluster_id long, centroid array<double>")


def collected(centroids: DataFrame) -> Centroids:
    """Centroids of a table (cluster_id, centroid); k rows."""
    rows = centroids.select("cluster_id", doubles(F.col("centroid")).alias("c")).orderBy("cluster_id").collect()
    return Centroids(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64))


def random_init(points: DataFrame, k: int, seed: int = 0) -> Centroids:
    """K4: k points without replacement, by a seeded order of ids, then sorted by id; k is clamped."""
    rows = points.select("id", doubles(F.col("embedding")).alias("v")).orderBy(draw_order(seed, F.col("id")), "id").limit(k).collect()
    rows.sort(key=lambda r: r[0])
    return Centroids(np.arange(len(rows)), np.array([r[1] for r in rows], np.float64))


def plus_plus_init(points: DataFrame, k: int, seed: int = 0, folder: str | None = None, every: int = 25) -> Centroids:
    """K1-K3: k-means++ with 2 + ln k candidates for each place, the one of least potential wins.

    The squared distance of each point to the nearest chosen centre is kept and only compared with the new one,
    so k places cost k distances of a point.  It weights a seeded draw (the candidates of the smallest
    -log(u) / weight, which is a draw by weight without sorting or a running sum), and one pass sums the
    potentials of all candidates.  With a ``folder`` the chosen centres are written every ``every`` places, and
    a broken-off run goes on from there.
    """
    spark = points.sparkSession
    slim = points.select("id", doubles(F.col("embedding")).alias("embedding"))
    trials = 2 + int(math.log(max(1, k)))
    chosen = list(saved(spark, folder)[1].rows) if folder and saved(spark, folder) else []
    if not chosen:
        chosen = [np.array(r["embedding"]) for r in slim.orderBy(draw_order(seed, F.col("id")), "id").limit(1).collect()]
    total = slim.count()
    kept = slim.withColumn("dist", F.lit(math.inf))
    since = 0  # the centres from here on are not in ``kept`` yet
    while chosen and len(chosen) < min(k, total):
        near = _nearer(kept, np.array(chosen[since:]))
        if len(chosen) - since >= 4:
            kept, since = cut(near), len(chosen)
            near = kept
        key = -F.log(uniform(f"{seed}|{len(chosen)}", F.col("id"))) / F.col("dist")
        rows = near.where(F.col("dist") > 0).orderBy(key, "id").limit(trials).select("id", "embedding").collect()
        if not rows:
            break
        candidates = [np.array(r["embedding"]) for r in sorted(rows, key=lambda r: r["id"])]
        chosen.append(candidates[int(np.argmin(_potentials(near, np.array(candidates))))])
        if folder and len(chosen) % every == 0:
            save(spark, folder, len(chosen), Centroids(np.arange(len(chosen)), np.array(chosen)))
    return Centroids(np.arange(len(chosen)), np.array(chosen))


def _nearer(kept: DataFrame, new: np.ndarray) -> DataFrame:
    """The points (id, embedding, dist) with the smaller of dist and the squared distance to the new centres."""
    if not len(new):
        return kept
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, x = matrix(batch, 1, new.shape[1])
            _, d = nearest(x, new, "l2")
            few = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array(np.minimum(d, few.column(2).to_numpy()))], names=["id", "embedding", "dist"])

    return kept.select("id", "embedding", "dist").mapInArrow(run, f"id {kind}, embedding array<double>, dist double")


def _potentials(near: DataFrame, candidates: np.ndarray) -> np.ndarray:
    """The sum of the distances ``dist`` of ``near`` if a candidate came in, for each candidate."""

    def run(batches):
        total = np.zeros(len(candidates))
        for batch in batches:
            rows, x = matrix(batch, 0, candidates.shape[1])
            d = batch.column(1).to_numpy()[rows]
            for j, c in enumerate(candidates):
                total[j] += np.minimum(d, ((x - c) ** 2).sum(axis=1)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(candidates))), pa.array(total)], names=["j", "t"])

    rows = near.select("embedding", "dist").mapInArrow(run, "j long, t double").groupBy("j").agg(F.sum("t").alias("t")).collect()
    out = np.zeros(len(candidates))
    for r in rows:
        out[r["j"]] = r["t"]
    return out


def save(spark, folder: str, step: int, centroids: Centroids) -> None:
    """The centroids after a step, as a folder step=n."""
    centroids.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/step={step}")


def saved(spark, folder: str) -> tuple[int, Centroids] | None:
    """The last step that was written to its end, and its centroids."""
    step = latest_step(spark, folder)
    return None if step is None else (step, collected(spark.read.parquet(f"{folder.rstrip('/')}/step={step}")))


def assign(points: DataFrame, centroids: Centroids, kind: str = "l2") -> DataFrame:
    """K5/K6: (id, cluster_id, dist) of the nearest centroid; a tie goes to the smallest cluster id."""
    return assigned(points, centroids.rows, centroids.ids, kind)


def assign_sql(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """The same as one expression: every point against the broadcast centroids, least (distance, id).  For more
    than EXPRESSION_CENTRES of them, the product of matrices."""
    if centroids.limit(EXPRESSION_CENTRES + 1).count() > EXPRESSION_CENTRES:
        return assign(points, collected(centroids)).select("id", "cluster_id", "dist")
    pairs = points.select("id", "embedding").join(F.broadcast(centroids), F.lit(True))
    best = F.min(F.struct(squared_l2(F.col("embedding"), F.col("centroid")).alias("dist"), "cluster_id"))
    return pairs.groupBy("id").agg(best.alias("b")).select("id", F.col("b.cluster_id").alias("cluster_id"), F.col("b.dist").alias("dist"))


def update(points: DataFrame, centroids: Centroids, kind: str = "l2") -> Centroids:
    """A2/A3: mean of the vectors nearest to each centroid; an empty cluster keeps its centroid."""
    new = centroids.rows.copy()
    place = {int(c): j for j, c in enumerate(centroids.ids)}
    for r in partial_sums(points, centroids.rows, centroids.ids, kind).collect():  # k rows
        new[place[r["cluster_id"]]] = np.array(r["sums"]) / r["n"]
    return Centroids(centroids.ids, new)


def means_of(points: DataFrame, assignment: DataFrame, previous: DataFrame) -> DataFrame:
    """A2 for any given assignment, as tables: (cluster_id, centroid)."""
    long = assignment.select("id", "cluster_id").join(points.select("id", "embedding"), "id")
    cells = long.select("cluster_id", F.posexplode(doubles(F.col("embedding"))).alias("pos", "x")).groupBy("cluster_id", "pos").agg(F.avg("x").alias("x"))
    means = cells.groupBy("cluster_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean")
    )
    return previous.join(means, "cluster_id", "left").select("cluster_id", F.coalesce("mean", "centroid").alias("centroid"))


def lloyd(
    points: DataFrame, start: Centroids, iterations: int, kind: str = "l2", folder: str | None = None, every: int = 5, most: int = 3
) -> Centroids:
    """K7/K9: ``iterations`` updates, no test of convergence.  One job each, k rows come back.

    With a ``folder`` the centroids are written after every ``every`` updates and the last one, of which the latest
    ``most`` are kept (R6); a run that was broken off goes on after the last one written.
    """
    now, done = start, 0
    spark = points.sparkSession
    if folder and (found := saved(spark, folder)):
        done, now = found
    for step in range(done, iterations):
        now = update(points, now, kind)
        if folder and ((step + 1) % every == 0 or step + 1 == iterations):
            save(spark, folder, step + 1, now)
            keep_steps(spark, folder, most)
    return now


def hierarchical(
    points: DataFrame,
    clusters: list[int],
    iterations: int,
    seed: int = 0,
    starts: int = 1,
    resampling: list[int] | None = None,
    sample_size: list[int] | None = None,
    strategy: str = "c",
    plus_plus: bool = False,
    folder: str | None = None,
) -> list[Centroids]:
    """The centroids of each level from the lowest; level 1 clusters the points, each further one the
    centroids below it.  Levels may be resampled (K11).  With a ``folder`` a finished level is not computed again.
    """
    spark = points.sparkSession
    out: list[Centroids] = []
    now = points.select("id", "embedding")
    for level, k in enumerate(clusters):
        own = f"{folder.rstrip('/')}/level={level + 1}" if folder else None
        found = saved(spark, own) if own else None
        if found:
            c = found[1]
        else:
            c = kmeans(now, k, iterations, starts, seed, plus_plus)
            if resampling and sample_size and resampling[level]:
                c = resampled(now, c, resampling[level], sample_size[level], iterations, strategy, seed)
            if own:
                save(spark, own, 1, c)
        out.append(c)
        now = c.table(spark).select(F.col("cluster_id").alias("id"), F.col("centroid").alias("embedding"))
    return out


def levels(points: DataFrame, tree: list[Centroids]) -> DataFrame:
    """(id, level_1, ..., level_n), the cluster of each point at each level of a hierarchy."""
    spark = points.sparkSession
    out = assign(points, tree[0]).select("id", F.col("cluster_id").alias("level_1"))
    for n in range(1, len(tree)):
        below = tree[n - 1].table(spark).select(F.col("cluster_id").alias("id"), F.col("centroid").alias("embedding"))
        up = assign(below, tree[n]).select(F.col("id").alias(f"level_{n}"), F.col("cluster_id").alias(f"level_{n + 1}"))
        out = out.join(small(up), f"level_{n}")
    return out.select("id", *(f"level_{n + 1}" for n in range(len(tree))))


def potential(points: DataFrame, assignment: DataFrame, centroids: DataFrame) -> Column | DataFrame:
    """Sum over the clusters of squared distances to the mean of the members."""
    means = means_of(points, assignment, centroids)
    both = assignment.select("id", "cluster_id").join(points.select("id", "embedding"), "id").join(small(means), "cluster_id")
    return both.agg(F.sum(squared_l2(F.col("embedding"), F.col("centroid"))).alias("potential"))


def kmeans(points: DataFrame, k: int, iterations: int, starts: int = 1, seed: int = 0, plus_plus: bool = False) -> Centroids:
    """The best of several starts by potential; k is clamped to the number of points."""
    begin = plus_plus_init if plus_plus else random_init
    best, least = None, math.inf
    for s in range(starts):
        c = lloyd(points, begin(points, k, seed + s), iterations)
        if starts == 1:
            return c
        spread = assign(points, c).agg(F.sum("dist")).first()[0] or 0.0
        if spread < least:
            best, least = c, spread
    return best


def cluster_lists(assignment: DataFrame, clusters: DataFrame) -> DataFrame:
    """A4: (cluster_id, members) with the ids ascending; a cluster without members has an empty list.  A cluster
    is one row; for clusters of many millions see :func:`list_chunks`."""
    lists = assignment.groupBy("cluster_id").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return clusters.select("cluster_id").join(lists, "cluster_id", "left").select(
        "cluster_id", F.coalesce("members", F.array().cast("array<bigint>")).alias("members")
    )


def list_chunks(assignment: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A4 for clusters of any size: (cluster_id, chunk, members), ids ascending through the chunks of ``rows``
    places of the whole table, so no row outgrows that."""
    placed = numbered(assignment.select("cluster_id", "id"), "cluster_id", "id", name="place")
    chunk = F.floor(F.col("place") / rows)
    lists = placed.groupBy("cluster_id", chunk.alias("chunk")).agg(F.array_sort(F.collect_list("id")).alias("members"))
    first = lists.groupBy("cluster_id").agg(F.min("chunk").alias("first"))
    return lists.join(first, "cluster_id").select("cluster_id", (F.col("chunk") - F.col("first")).alias("chunk"), "members")


def sorted_by_distance(points: DataFrame, assignment: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster_id, id, dist, rank_in_cluster) by Euclidean distance to the centroid, ties by id."""
    both = assignment.select("id", "cluster_id").join(points.select("id", "embedding"), "id").join(small(centroids), "cluster_id")
    d = both.select("cluster_id", "id", l2(F.col("embedding"), F.col("centroid")).alias("dist"))
    w = W.partitionBy("cluster_id").orderBy("dist", "id")
    return d.withColumn("rank_in_cluster", F.row_number().over(w))


def closest(ranked: DataFrame, n: int) -> DataFrame:
    """L3/M3: the first ``n`` of each cluster."""
    return ranked.where(F.col("rank_in_cluster") <= n)


def resampled(
    points: DataFrame, start: Centroids, steps: int, sample_size: int, iterations: int, strategy: str = "c", seed: int = 0
) -> Centroids:
    """K-means on a sample of each cluster, ``steps`` times; the caller assigns all points.

    Strategy c takes the closest of each cluster, r random ones.  A sample of one or fewer changes nothing.
    """
    if strategy not in ("c", "r"):
        raise ValueError(f"unknown strategy {strategy!r}")
    now = start
    for step in range(steps if sample_size > 1 else 0):
        near = assign(points, now)
        by = [F.col("dist"), F.col("id")] if strategy == "c" else [draw_order(f"{seed}|{step}", F.col("id")), F.col("id")]
        w = W.partitionBy("cluster_id").orderBy(*by)
        sample = near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= sample_size).select("id")
        chosen = points.select("id", "embedding").join(sample, "id")
        now = lloyd(chosen, random_init(chosen, len(now.ids), seed + step), iterations)
    return now


def split(points: DataFrame, assignment: DataFrame, pieces: int, iterations: int = 10, starts: int = 3, seed: int = 0, most: int = 2_000_000) -> DataFrame:
    """K-means within each cluster: (id, parent_id, cluster_id, dist, rank_in_cluster).

    Clusters up to ``most`` vectors are one task each; a larger one is split by the distributed loop.  New
    ids count through the parents in order; a piece without members has none.
    """
    sizes = assignment.groupBy("cluster_id").count()
    large = [r["cluster_id"] for r in sizes.where(F.col("count") > most).collect()]  # at most rows / most
    both = assignment.select("id", F.col("cluster_id").alias("parent_id")).join(points.select("id", doubles(F.col("embedding")).alias("embedding")), "id")

    def one(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy())
        ids = table.column("id").to_numpy()[order]
        x = np.array(table.column("embedding").to_pylist(), float)[order]
        parent = table.column("parent_id")[0].as_py()
        k, best = min(pieces, len(x)), None
        for s in range(starts):
            rng = np.random.default_rng([seed, s, abs(parent)])
            c = x[np.sort(rng.choice(len(x), k, replace=False))]
            for _ in range(iterations):
                near, _ = nearest(x, c, "l2")
                c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
            near, d = nearest(x, c, "l2")
            if best is None or d.sum() < best[0]:
                best = (d.sum(), near, d)
        return pa.table({"id": ids, "parent_id": np.full(len(ids), parent), "piece": best[1], "dist": np.sqrt(best[2])})

    schema = "id long, parent_id long, piece long, dist double"
    out = both.where(~F.col("parent_id").isin(large)) if large else both
    out = out.groupBy("parent_id").applyInArrow(one, schema)
    for parent in large:
        own = both.where(F.col("parent_id") == parent)
        c = kmeans(own, pieces, iterations, starts, seed)
        out = out.unionByName(assign(own, c).select("id", F.lit(parent).cast("long").alias("parent_id"), F.col("cluster_id").alias("piece"), F.sqrt("dist").alias("dist")))
    new = numbered(out.select("parent_id", "piece").distinct(), "parent_id", "piece", name="cluster_id")
    w = W.partitionBy("cluster_id").orderBy("dist", "id")
    return out.join(small(new), ["parent_id", "piece"]).select(
        "id", "parent_id", "cluster_id", "dist", F.row_number().over(w).alias("rank_in_cluster")
    )
