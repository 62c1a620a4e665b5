"""Exact neighbours and retrieval by queries (rows J8, J9, J16, L1, L2, Q1-Q5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.operators.blocks import matrix
from winnow.operators.vectors import cosine, doubles, l2

#: Bytes of the queries that one pass holds in memory.
QUERY_BYTES = 64 << 20


def similar_to(features: DataFrame, query: int, k: int) -> DataFrame:
    """Q4/L1/L2: the k rows most similar to one row by cosine, without itself."""
    q = F.broadcast(features.where(F.col("id") == query).select(F.col("embedding").alias("q")).limit(1))
    sim = features.where(F.col("id") != query).join(q, F.lit(True)).select("id", cosine(F.col("embedding"), F.col("q")).alias("similarity"))
    return sim.orderBy(F.desc("similarity"), "id").limit(k)


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ q.T) + (q * q).sum(axis=1)[None, :]
        return np.sqrt(np.maximum(d, 0))
    nx, nq = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    nx[nx == 0], nq[nq == 0] = 1e-10, 1e-10
    return 1 - (x / nx[:, None]) @ (q / nq[:, None]).T


def knn(features: DataFrame, queries: DataFrame, k: int, metric: str = "l2", dim: int = 64, itself: bool = False) -> DataFrame:
    """(id, rank, neighbor_id, distance): exact k nearest rows of ``features`` of every query.

    ``metric`` l2 is the Euclidean distance, cos is 1 - cosine.  A query meets all rows: blocks of queries of
    QUERY_BYTES are sent to the rows, each task keeps the k best of a query over all its rows, and a window
    ranks the few lists of a query.  The distances of the kept pairs are measured directly, ties go to the smaller
    id.
    """
    if metric not in ("l2", "cos"):
        raise ValueError(f"unknown metric {metric!r}")
    spark = features.sparkSession
    slim = queries.select("id", doubles(F.col("embedding")).alias("embedding")).where(F.size("embedding") == dim)
    blocks = max(1, -(-slim.count() * dim * 8 // QUERY_BYTES))
    parts: DataFrame | None = None
    for b in range(blocks):
        own = slim if blocks == 1 else slim.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        table = own.toArrow()
        batches = table.combine_chunks().to_batches()
        ids = np.concatenate([x.column(0).to_numpy(zero_copy_only=False)[matrix(x, 1, dim)[0]] for x in batches]) if batches else np.zeros(0, np.int64)
        vectors = np.concatenate([matrix(x, 1, dim)[1] for x in batches]) if batches else np.zeros((0, dim))
        shared = spark.sparkContext.broadcast((ids.astype(np.int64), vectors))
        found = features.select("id", "embedding").mapInArrow(_search(shared, k, metric, dim, itself), "id long, neighbor_id long, distance double")
        parts = found if parts is None else parts.unionAll(found)
    w = W.partitionBy("id").orderBy("distance", "neighbor_id")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "rank", "neighbor_id", "distance")


def _search(shared, k: int, metric: str, dim: int, itself: bool):
    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if metric == "l2":
            return np.sqrt(((a - b) ** 2).sum(axis=1))
        lengths = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        return 1 - np.where(lengths == 0, 0, (a * b).sum(axis=1) / np.where(lengths == 0, 1, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best = np.full((len(ids), k), np.inf)
        names = np.full((len(ids), k), -1, np.int64)
        for batch in batches:
            rows, x = matrix(batch, 1, dim)
            own = batch.column(0).to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            if not len(own) or not len(ids):
                continue
            step = max(1, 4_000_000 // len(own))
            for at in range(0, len(ids), step):
                part = slice(at, at + step)
                d = _scores(q[part], x, metric)
                if not itself:
                    d[ids[part][:, None] == own[None, :]] = np.inf
                m = min(k, d.shape[1])
                bound = np.minimum(np.partition(d, m - 1, axis=1)[:, m - 1], best[part, -1])
                i, j = np.nonzero((d <= bound[:, None] + 1e-7) & np.isfinite(d))
                i0, j0 = np.nonzero(names[part] >= 0)
                row = np.r_[i, i0]
                name = np.r_[own[j], names[part][i0, j0]]
                dist = np.r_[exact(q[at + i], x[j]), best[part][i0, j0]]
                order = np.lexsort((name, dist, row))
                row, name, dist = row[order], name[order], dist[order]
                place = np.arange(len(row))
                turn = place - np.maximum.accumulate(np.where(np.r_[True, row[1:] != row[:-1]], place, 0)) if len(row) else place
                few = turn < k
                best[at + row[few], turn[few]], names[at + row[few], turn[few]] = dist[few], name[few]
        i, j = np.nonzero(names >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(names[i, j]), pa.array(best[i, j])], names=["id", "neighbor_id", "distance"])

    return run


def pair_distances(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(id_a, id_b, distance), the Euclidean distance of given pairs."""
    a = features.select(F.col("id").alias("id_a"), F.col("embedding").alias("va"))
    b = features.select(F.col("id").alias("id_b"), F.col("embedding").alias("vb"))
    return pairs.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", l2(F.col("va"), F.col("vb")).alias("distance"))


def normalised_table(features: DataFrame) -> DataFrame:
    """The table that a flat index holds: vectors of length one."""
    from winnow.operators.vectors import l2_normalised

    return features.select("id", l2_normalised(F.col("embedding")).alias("embedding"))


def inner_product(a: Column, b: Column) -> Column:
    from winnow.operators.vectors import dot

    return dot(a, b)
