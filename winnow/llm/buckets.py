"""Leaves of a forest as tasks: from a table of vectors to groups of vectors that one task compares."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from winnow.functions.workers import Shipped
from winnow.llm.forest import Forest, ForestConfig, fit_forest
from winnow.llm.packs import PACKED, mix, packed, regroup, sampled, unit, unpack_all, usable

#: Visitors of one task, in times of the rows that a leaf may have at home.
VISITORS = 4


@dataclass
class Index:
    """A forest, and the vectors of which very many rows are copies.

    ``heavy`` has the bytes of each such vector and the smallest ids of its rows.  Only these rows take
    part in the forest; what holds for a copy with a larger id follows from them, without moving it.
    """

    forest: Forest
    rows: int
    heavy: dict[bytes, np.ndarray]


def _keys(x: np.ndarray) -> list[bytes]:
    """The bytes of each unit vector in single precision."""
    single = np.ascontiguousarray(unit(x).astype(np.float32) + np.float32(0))  # no negative zeros
    width = single.shape[1] * 4
    raw = single.tobytes()
    return [raw[at : at + width] for at in range(0, len(raw), width)]


def fitted(df: DataFrame, config: ForestConfig, ids: str = "id", vectors: str = "embedding", first: int = 6) -> Index:
    """A forest for the table, fitted on a sample of at most about ``config.sample_most`` rows.

    Vectors of which the sample promises more than half of ``config.leaf_max`` copies are heavy; there are at
    most ``2 * rows / leaf_max`` of them.  The ``first`` smallest ids of each are gathered from all rows; with 0 no
    vector is heavy.
    """
    rows = df.select(ids).count()
    wanted = min(config.sample_most, max(config.sample_rows, config.leaf_sample * rows // config.leaf_max))
    sample = sampled(df, rows, wanted, config.dim, ids, vectors, config.seed)
    config = replace(config, dim=sample.shape[1] if sample.size else config.dim)
    keys, count = np.unique(np.array(_keys(sample), object), return_counts=True) if len(sample) else ([], np.zeros(0))
    often = max(8.0, config.leaf_max / 2 * len(sample) / max(1, rows))
    heavy = {k: np.zeros(0, np.int64) for k, c in zip(keys, count, strict=True) if first and c >= often and rows > config.leaf_max}
    if heavy:
        at = {k: n for n, k in enumerate(heavy)}
        dim = config.dim

        def smallest(i: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
            i, own = np.unique(i, return_index=True)
            which = which[own]
            order = np.lexsort((i, which))
            i, which = i[order], which[order]
            begin = np.maximum.accumulate(np.where(np.r_[True, which[1:] != which[:-1]], np.arange(len(i)), 0))
            few = np.arange(len(i)) - begin < first
            return pa.RecordBatch.from_arrays([pa.array(which[few]), pa.array(i[few])], names=["heavy", "id"])

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            i, which = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for batch in parts:
                j, x = usable(batch, dim, ids, vectors)
                if not len(j):
                    continue
                w = np.array([at.get(k, -1) for k in _keys(x)])
                kept = smallest(np.r_[i, j[w >= 0]], np.r_[which, w[w >= 0]])
                which, i = (c.to_numpy() for c in kept.columns)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(i)], names=["heavy", "id"])

        found = df.select(ids, vectors).mapInArrow(run, "heavy long, id long").toArrow()  # at most ``first`` a partition and vector
        if found.num_rows:
            kept = smallest(found.column("id").to_numpy(), found.column("heavy").to_numpy())
            which, i = (c.to_numpy() for c in kept.columns)
            heavy = {k: i[which == n] for k, n in at.items()}
        sample = sample[[k not in heavy for k in _keys(sample)]]
    return Index(fit_forest(sample, rows, config), rows, heavy)


def tasks_of(forest: Forest) -> np.ndarray:
    """First task number of each leaf, and the number of all tasks as the last entry."""
    most = VISITORS * forest.config.leaf_max
    return np.concatenate([[0], np.cumsum(np.maximum(1, np.ceil(forest.expected_visits / most)))]).astype(np.int64)


def visits(forest: Forest, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, task, home) of every task that a vector takes part in."""
    row, leaf, home = forest.route(unit(x).astype(np.float32))
    first = tasks_of(forest)
    parts = np.diff(first)[leaf]
    task = first[leaf] + (mix(ids[row]) % parts.astype(np.uint64)).astype(np.int64)
    many = np.flatnonzero(home & (parts > 1))  # a row at home is in all tasks of its leaf
    if len(many):
        again = np.repeat(many, parts[many])
        nth = np.arange(len(again)) - np.repeat(np.cumsum(parts[many]) - parts[many], parts[many])
        one = np.setdiff1d(np.arange(len(row)), many)
        row, task, home = np.r_[row[one], row[again]], np.r_[task[one], first[leaf[again]] + nth], np.r_[home[one], home[again]]
    return row, task, home


def compared(
    df: DataFrame,
    index: Index,
    work: Callable[..., pa.Table],
    schema: str,
    ids: str = "id",
    vectors: str = "embedding",
) -> DataFrame:
    """Run ``work(ids, vectors, home)`` on every task.

    ids are distinct and ascending; home tells the rows at home in the leaf from its visitors.  Rows that
    :func:`of_heavy` accounts for are left out.
    """
    dim = index.forest.config.dim
    shared = Shipped(df.sparkSession, index)  # as large as its sample allows
    kinds = [(np.int64, 0), (np.float32, dim), (np.int8, 0)]

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        forest, heavy = own.forest, own.heavy
        for i, x in _gathered(parts, dim, ids, vectors):
            if heavy:
                few = [(at := heavy.get(k)) is None or n in at for n, k in zip(i, _keys(x), strict=True)]
                i, x = i[few], x[few]
            row, task, home = visits(forest, i, x)
            yield packed(task, [i[row], x[row], home.astype(np.int8)])

    def receive(table: pa.Table) -> pa.Table:
        i, x, home = unpack_all(table.column("pack"), kinds)
        i, at = np.unique(i, return_index=True)  # rows delivered twice
        return work(i, x[at], home[at] > 0)

    routed = df.select(ids, vectors).mapInArrow(send, PACKED)
    return regroup(routed, int(tasks_of(index.forest)[-1]), receive, schema)


def of_heavy(
    df: DataFrame, index: Index, work: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], schema: str, ids: str, vectors: str
) -> DataFrame | None:
    """``work(ids, firsts)`` over the copies that :func:`compared` leaves out; firsts has for each the smallest
    ids of its vector.  None if there are none."""
    if not index.heavy:
        return None
    dim = index.forest.config.dim
    shared = df.sparkSession.sparkContext.broadcast(index.heavy)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = shared.value
        for i, x in _gathered(parts, dim, ids, vectors):
            lists = [heavy.get(k) for k in _keys(x)]
            left = [n for n, at in enumerate(lists) if at is not None and i[n] not in at]
            if left:
                yield work(i[left], np.stack([lists[n] for n in left]))

    return df.select(ids, vectors).mapInArrow(run, schema)


def _gathered(
    parts: Iterator[pa.RecordBatch], dim: int, ids: str, vectors: str, rows: int = 50_000
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The usable vectors of the batches, about ``rows`` at a time: larger packs are compressed better."""
    i: list[np.ndarray] = []
    x: list[np.ndarray] = []
    for batch in parts:
        j, y = usable(batch, dim, ids, vectors)
        if len(j):
            i.append(j)
            x.append(y)
        if sum(map(len, i)) >= rows:
            yield np.concatenate(i), np.concatenate(x)
            i, x = [], []
    if i:
        yield np.concatenate(i), np.concatenate(x)
