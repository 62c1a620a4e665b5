"""Vectors of Arrow batches as matrices, and the products that SQL is slow at."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def matrix(batch: pa.RecordBatch, column: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values) of the vectors of ``dim`` components, none of them null."""
    e = batch.column(column)
    starts = e.offsets.to_numpy()
    ok = (np.diff(starts) == dim) & e.is_valid().to_numpy(zero_copy_only=False)
    flat = e.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat[starts[:-1][ok][:, None] + np.arange(dim)] if ok.any() else np.zeros((0, dim))
    rows = np.flatnonzero(ok)
    if e.values.null_count:
        full = ~np.isnan(x).any(axis=1)
        rows, x = rows[full], x[full]
    return rows, x


def nearest(x: np.ndarray, centres: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(centre, distance) of the nearest centre of each row; ties go to the first centre.

    The product finds the candidates; those within its error of the best are measured directly.
    """
    out, dist = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, 4_000_000 // max(1, len(centres)))
    norms = np.einsum("ij,ij->i", centres, centres)
    for at in range(0, len(x), step):
        p = x[at : at + step]
        d = -2 * (p @ centres.T) + (norms if kind == "l2" else 0.0)
        slack = 1e-9 * (1 + np.einsum("ij,ij->i", p, p) + norms.max(initial=0))
        row, col = np.nonzero(d <= d.min(axis=1)[:, None] + slack[:, None])
        exact = (
            np.einsum("ij,ij->i", p[row] - centres[col], p[row] - centres[col])
            if kind == "l2"
            else 2 - 2 * np.einsum("ij,ij->i", p[row], centres[col])
        )
        order = np.lexsort((col, exact, row))
        first = order[np.r_[True, row[order][1:] != row[order][:-1]]]
        out[at : at + step], dist[at : at + step] = col[first], exact[first]
    return out, dist


def assigned(df: DataFrame, centres: np.ndarray, ids: np.ndarray, kind: str, id_: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, cluster_id, dist): nearest centre of every vector of the centres' dimension.

    ``centres`` are k rows that fit an executor many times over; ``ids`` are their numbers, ascending.
    """
    if kind not in ("l2", "cos"):
        raise ValueError(f"unknown distance {kind!r}")
    if centres.nbytes > 1 << 30:
        raise ValueError("the table of centroids is larger than 1 GB")
    shared = df.sparkSession.sparkContext.broadcast((centres, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, names = shared.value
        for batch in batches:
            rows, x = matrix(batch, 1, c.shape[1])
            near, d = nearest(x, c, kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(names[near].astype(np.int64)), pa.array(d)],
                names=[id_, "cluster_id", "dist"],
            )

    kind_of_id = df.schema[id_].dataType.simpleString()
    return df.select(id_, vector).mapInArrow(run, f"`{id_}` {kind_of_id}, cluster_id long, dist double")


def partial_sums(df: DataFrame, centres: np.ndarray, ids: np.ndarray, kind: str, vector: str = "embedding") -> DataFrame:
    """(cluster_id, n, sums): sums of the vectors nearest to each centre, added up in each partition first."""
    shared = df.sparkSession.sparkContext.broadcast((centres, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, names = shared.value
        count, total = np.zeros(len(c), np.int64), np.zeros(c.shape)
        for batch in batches:
            _, x = matrix(batch, 0, c.shape[1])
            near, _ = nearest(x, c, kind)
            count += np.bincount(near, minlength=len(c))
            order = np.argsort(near, kind="stable")
            if len(order):
                starts = np.flatnonzero(np.r_[True, np.diff(near[order]) != 0])
                total[near[order][starts]] += np.add.reduceat(x[order], starts)
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[has].astype(np.int64)), pa.array(count[has]), pa.array(list(total[has]), pa.list_(pa.float64()))],
            names=["cluster_id", "n", "sums"],
        )

    def add(table: pa.Table) -> pa.Table:
        sums = np.array(table.column("sums").to_pylist()).sum(axis=0)
        n = int(np.sum(table.column("n").to_numpy()))
        return pa.table({"cluster_id": table.column("cluster_id").slice(0, 1), "n": [n], "sums": pa.array([sums], pa.list_(pa.float64()))})

    schema = "cluster_id long, n long, sums array<double>"
    return df.select(vector).mapInArrow(run, schema).groupBy("cluster_id").applyInArrow(add, schema)
