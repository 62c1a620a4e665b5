"""Vectors between Arrow, NumPy and shuffles.

A shuffle of vectors moves *packs*: all rows of one Arrow batch that go to the same task travel as one
binary value, ids and components as separate compressed byte planes.  A pack is lossless.  That costs
the JVM one row for thousands of vectors, and the network about half of the bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODEC = "zstd"


def usable(batch: pa.RecordBatch, dim: int, ids: str = "id", vectors: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Ids and components of the rows whose vector has exactly ``dim`` finite numbers, not all zero.

    Rows with a null id, a null vector, a null component, another length, a component that is not
    finite, or only zeros are left out.
    """
    i, e = batch.column(ids), batch.column(vectors)
    if isinstance(e, pa.ChunkedArray):
        i, e = i.combine_chunks(), e.combine_chunks()
    start = e.offsets.to_numpy()
    ok = np.diff(start) == dim
    if e.null_count:
        ok &= e.is_valid().to_numpy(zero_copy_only=False)
    if i.null_count:
        ok &= i.is_valid().to_numpy(zero_copy_only=False)
    values = e.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    rows = np.flatnonzero(ok)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
    x = flat[start[rows][:, None] + np.arange(dim)]
    good = np.isfinite(x).all(1) & (x != 0).any(1)  # a null component arrives as NaN
    numbers = i.fill_null(0) if i.null_count else i
    return numbers.to_numpy(zero_copy_only=False).astype(np.int64)[rows[good]], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision; scaled by the largest part first, as squares may overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True) if x.size else 1.0
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _planes(a: np.ndarray) -> bytes:
    a = np.ascontiguousarray(a)
    raw = a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
    return pa.compress(raw, codec=CODEC, asbytes=True) if raw else b""


def _array(blob: memoryview, dtype: np.dtype, count: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not count:
        return np.zeros(0, dtype)
    raw = pa.decompress(blob, decompressed_size=size * count, codec=CODEC, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, count).T).view(dtype).ravel()


def pack(*columns: np.ndarray) -> bytes:
    """One value that holds columns of equal length; a column may have a second dimension."""
    parts = [_planes(c) for c in columns]
    return struct.pack(f"<q{len(parts)}q", len(columns[0]), *map(len, parts)) + b"".join(parts)


def unpack(blob: bytes, kinds: list[tuple[type, int]]) -> list[np.ndarray]:
    """The columns of a pack; kinds are (dtype, width), width 0 for a plain column."""
    n, *sizes = struct.unpack_from(f"<q{len(kinds)}q", blob)
    at, out, view = 8 + 8 * len(kinds), [], memoryview(blob)
    for (dtype, width), size in zip(kinds, sizes, strict=True):
        a = _array(view[at : at + size], dtype, n * max(1, width))
        out.append(a.reshape(n, width) if width else a)
        at += size
    return out


def unpack_all(blobs: pa.ChunkedArray, kinds: list[tuple[type, int]]) -> list[np.ndarray]:
    parts = [unpack(b.as_buffer().to_pybytes(), kinds) for chunk in blobs.chunks for b in chunk]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


PACKED = "task long, pack binary"


def packed(task: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Columns split by task, one pack for each."""
    order = np.argsort(task, kind="stable")
    bounds = np.flatnonzero(np.diff(task[order])) + 1
    groups = np.split(order, bounds) if len(order) else []
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(task[g[0]]) for g in groups], pa.int64()),
            pa.array([pack(*(c[g] for c in columns)) for g in groups], pa.binary()),
        ],
        names=["task", "pack"],
    )


def regroup(df: DataFrame, tasks: int, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Run ``work`` on the packs of each task.  The partitions are set here, as adaptive execution
    would join partitions of few bytes, and these hold few bytes for much work; some tasks share one, as each
    costs a start of Python's worker."""
    parts = max(1, min(tasks, max(3 * df.sparkSession.sparkContext.defaultParallelism, -(-tasks // 4))))
    return df.repartition(parts, "task").groupBy("task").applyInArrow(work, schema)


def mix(ids: np.ndarray, seed: int = 0) -> np.ndarray:
    """A spread of ids that depends on nothing but the id and the seed."""
    x = ids.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled(df: DataFrame, rows: int, bound: int, dim: int, ids: str, vectors: str, seed: int) -> np.ndarray:
    """Unit vectors of about ``bound`` rows, chosen by a hash of the id, for fitting an index."""
    few = df.select(ids, vectors)
    if rows > bound:
        few = few.where(F.pmod(F.xxhash64(F.lit(seed), F.col(ids)), F.lit(1 << 30)) < int((1 << 30) * bound / rows))
    table = few.limit(2 * bound).toArrow().combine_chunks()
    parts = [usable(b, dim, ids, vectors)[1] for b in table.to_batches()]
    return unit(np.concatenate(parts)).astype(np.float32) if parts else np.zeros((0, dim), np.float32)


def batches(work: Callable[[np.ndarray, np.ndarray], pa.RecordBatch | None], dim: int, ids: str, vectors: str):
    """A function for mapInArrow that hands the usable vectors of each batch to ``work``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, x = usable(batch, dim, ids, vectors)
            if len(i) and (out := work(i, x)) is not None:
                yield out

    return run
