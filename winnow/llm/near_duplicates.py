"""Near-duplicate records with small edits (problem 4)."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.buckets import compared, fitted
from winnow.llm.components import components
from winnow.llm.forest import ForestConfig
from winnow.llm.kernels import BLOCK, SLACK, copies, exact
from winnow.llm.packs import unit

CONFIG = ForestConfig(trees=1, miss=0.02, leaf_rows=16_384, leaf_max=65_536)
#: Directions that a run samples its tokens from.
DIRECTIONS = 256
#: Width of a cell, in standard deviations of the step between two vectors of the least similarity along a direction.
WIDTH = 4.0


def chosen_paths(
    x: np.ndarray,
    floor: float,
    bucket: int = 384,
    recall: float = 0.99,
    least: int = 3,
    most: int = 80,
    seed: int = 1,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, col, cosine) of the pairs of at least ``floor``, by a chosen-path join.

    A record's tokens are the cells of its coordinates along random directions, each cut into cells at a random
    place.  A run starts with all records in one set.  For every set of more than ``bucket`` records it
    samples one or two directions, 1 / p on average, p being the chance that two records of the least similarity
    share a token; a record follows every sampled token that it holds, so such a pair has one common
    path on average.  Small sets are compared in full, and so are those that no direction parts any more.
    Copies take part as one record, and their pairs are added at the end: every run would find them, so they say
    nothing about the others.

    Runs are repeated until the pairs that no run has found yet are estimated at no more than a share of
    ``1 - recall`` (:func:`_complete`).  Where ``most`` runs don't reach that, or as many comparisons as all pairs
    take (a run costs about ``12 * bucket`` for each record), all pairs are compared: small sets at once.
    """
    first, own = copies(x.astype(np.float32))
    n = len(first)
    ones = x[first].astype(np.float32)
    rng = np.random.default_rng(seed)
    codes = np.zeros(0, np.int64)
    times = np.zeros(0, np.int64)
    sims = np.zeros(0)
    runs = 0
    while not _complete(sims, times, runs, floor, recall, least):
        if runs >= most or max(least, runs + 1) * 12 * bucket >= n // 2:
            codes = _hits(ones, floor, np.arange(n))
            break
        runs += 1
        hit = _run(ones, floor, bucket, rng)
        merged, at = np.unique(np.r_[codes, hit], return_inverse=True)
        count = np.zeros(len(merged), np.int64)
        count[at[: len(codes)]] = times
        count[at[len(codes) :]] += 1
        sim = np.full(len(merged), np.nan)
        sim[at[: len(codes)]] = sims
        new = np.isnan(sim)
        sim[new] = exact(x, x, first[merged[new] // n], first[merged[new] % n])
        codes, times, sims = merged, count, sim
    row, col = _members(codes // max(1, n), codes % max(1, n), own, n)
    sim = exact(x, x, row, col)
    ok = sim >= floor
    return row[ok], col[ok], sim[ok]


def _complete(sims: np.ndarray, times: np.ndarray, runs: int, floor: float, recall: float, least: int) -> bool:
    """Whether the pairs of different vectors that no run has found are few enough, also near the floor.

    With f1 pairs found by one run only and f2 by two, Chao's f1 * (f1 - 1) / (2 * (f2 + 1)) is a lower
    bound of what is missing, so the jackknife's f1 * (runs - 1) / runs is taken where it is more.  The
    pairs nearest to the floor are the likeliest to be split: the share holds for the lowest quarter and
    half of the similarities, too, not just for all.
    """
    if runs < least:
        return False
    for part in (0.25, 0.5, 1.0):
        seen = times[(sims >= floor) & (sims <= floor + part * (1 - floor) + (part == 1.0))]
        once, twice = int((seen == 1).sum()), int((seen == 2).sum())
        missing = max(once * max(0, once - 1) / (2 * (twice + 1)), once * (runs - 1) / runs)
        if missing > (1 - recall) * (len(seen) + missing):
            return False
    return True


def _members(row: np.ndarray, col: np.ndarray, own: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows, smaller row first, of pairs of classes and within each class."""
    members = np.argsort(own, kind="stable")
    size = np.bincount(own, minlength=classes)
    start = np.cumsum(size) - size
    several = np.flatnonzero(size > 1)
    row, col = np.r_[row, several], np.r_[col, several]
    many = size[row] * size[col]
    pair = np.repeat(np.arange(len(row)), many)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
    wide = size[col[pair]]
    i, j = members[start[row[pair]] + nth // wide], members[start[col[pair]] + nth % wide]
    ok = (row[pair] != col[pair]) | (i < j)
    i, j = i[ok], j[ok]
    return np.minimum(i, j), np.maximum(i, j)


def _hits(x: np.ndarray, floor: float, own: np.ndarray) -> np.ndarray:
    """Codes row * n + col, row < col, of the candidates among the rows ``own``, in blocks."""
    found = [np.zeros(0, np.int64)]
    y = x[own]
    tall, wide = 256, BLOCK // 256
    for at in range(0, len(own), tall):
        for over in range(at - at % wide, len(own), wide):
            near = np.flatnonzero((y[at : at + tall] @ y[over : over + wide].T).ravel() >= floor - SLACK)
            i, j = near // min(wide, len(own) - over) + at, near % min(wide, len(own) - over) + over
            later = j > i
            i, j = own[i[later]], own[j[later]]
            found.append(np.minimum(i, j) * len(x) + np.maximum(i, j))
    return np.concatenate(found)


def _run(x: np.ndarray, floor: float, bucket: int, rng: np.random.Generator) -> np.ndarray:
    """Distinct codes row * n + col, row < col, of the candidates of one run."""
    n, dim = x.shape
    step = np.sqrt((2 - 2 * floor) / dim)
    width = np.float32(WIDTH * max(step, 1e-4))
    shared = 1 - np.sqrt(2 / np.pi) / WIDTH
    directions = rng.standard_normal((DIRECTIONS, dim), dtype=np.float32)
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    along = x @ directions.T / width
    along -= along.min()
    cells = int(along.max()) + 3
    held, group = np.arange(n), np.zeros(n, np.int64)
    stuck = np.zeros(1, np.int64)  # for each set, how many tokens in a row didn't part it
    done: list[np.ndarray] = []
    while len(held):
        size = np.bincount(group)
        ends = np.cumsum(size)
        ready = (size <= bucket) | (stuck >= 8)
        done.extend(held[e - c : e] for e, c in zip(ends[ready].tolist(), size[ready].tolist(), strict=True) if c > 1)
        open_ = ~ready[group]
        held, group = held[open_], group[open_]
        sets = len(size)
        both = rng.random(sets) < 1 / shared - 1
        nexts = []
        for turn in range(2):
            d, shift = rng.integers(0, DIRECTIONS, sets), rng.random(sets, dtype=np.float32)
            part = slice(None) if turn == 0 else both[group]
            h, g = held[part], group[part]
            nexts.append((h, (g * 2 + turn) * cells + (along[h, d[g]] + shift[g]).astype(np.int64)))
        h, key = (np.concatenate(c) for c in zip(*nexts, strict=True))
        order = np.argsort(key, kind="stable")
        h, key = h[order], key[order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        child = np.cumsum(new) - 1
        parent = key[new] // (2 * cells)
        own = np.bincount(child, minlength=len(parent))
        whole = own >= 0.95 * size[parent]
        stuck = np.where(whole, stuck[parent] + 1, 0)
        keep = ~(whole & (key[new] // cells % 2 == 1))  # a second token that parts nothing would only double the set
        at = np.cumsum(keep) - 1
        held, group, stuck = h[keep[child]], at[child[keep[child]]], stuck[keep]
    found = [np.zeros(0, np.int64)]
    for rows in done:
        if len(rows) > bucket:
            found.append(_hits(x, floor, rows))
            continue
        y = x[rows]
        near = np.flatnonzero((y @ y.T).ravel() >= floor - SLACK)
        i, j = rows[near // len(rows)], rows[near % len(rows)]
        found.append(i[i < j] * n + j[i < j])
    return np.unique(np.concatenate(found))


def near_pairs(
    df: DataFrame,
    floor: float = 0.98,
    recall: float = 0.99,
    config: ForestConfig = CONFIG,
    ids: str = "id",
    vectors: str = "embedding",
) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b, of the vectors whose cosine is at least ``floor``.

    A record's first token decides the task: its leaf of a random-projection tree.  A record near a plane holds the
    tokens of both sides and follows them all, until the chance that a vector of cosine ``floor`` holds none
    of them is at most ``config.miss`` (:mod:`winnow.llm.forest`).  The rest of the path is taken within the
    task (:func:`chosen_paths`), where the vectors are at hand, so repeated runs move nothing.

    Defined cases: as for :func:`winnow.llm.neighbours.most_similar`; copies are pairs.
    """
    step = float(np.sqrt(max(0.0, 2 - 2 * floor)))
    index = fitted(df, replace(config, step=max(step, 1e-3)), ids, vectors, first=0)

    def work(i: np.ndarray, x: np.ndarray, home: np.ndarray) -> pa.Table:
        row, col, sim = chosen_paths(unit(x), floor, recall=recall)
        return pa.table({"id_a": i[row], "id_b": i[col], "similarity": sim})

    pairs = compared(df, index, work, "id_a long, id_b long, similarity double", ids, vectors)
    return pairs.groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def mosaic_key(name: Column) -> Column:
    """The five digits that tell mosaics apart, null for a null name or one without them."""
    return F.nullif(F.regexp_extract(name, r"(?<![0-9])([0-9]{5})(?![0-9])", 1), F.lit(""))


def compatible_pairs(pairs: DataFrame, records: DataFrame, apart: int = 64) -> DataFrame:
    """The pairs that neither name nor position contradicts.

    ``records`` has id, mosaic_name and position.  Names contradict if both denote a mosaic and the
    mosaics differ; positions if both have two numbers and differ by more than ``apart`` in one.
    Rows of one id that were delivered twice are equal; an id without a row contradicts nothing.
    """
    p = F.col("position")
    whole = p.isNotNull() & (F.size(p) == 2)
    places = records.select(
        "id",
        mosaic_key(F.col("mosaic_name")).alias("mosaic"),
        F.when(whole, F.get(p, F.lit(0))).alias("row"),
        F.when(whole, F.get(p, F.lit(1))).alias("col"),
    )
    wanted = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    places = places.join(wanted, "id", "left_semi").groupBy("id").agg(
        F.max(F.struct("mosaic", "row", "col")).alias("place")
    )
    both = pairs.join(places.select(F.col("id").alias("id_a"), F.col("place").alias("pa")), "id_a", "left").join(
        places.select(F.col("id").alias("id_b"), F.col("place").alias("pb")), "id_b", "left"
    )

    def far(field: str) -> Column:
        return F.abs(F.col(f"pa.{field}").cast("long") - F.col(f"pb.{field}").cast("long")) > apart

    complete = F.col("pa.row").isNotNull() & F.col("pa.col").isNotNull() & F.col("pb.row").isNotNull() & F.col("pb.col").isNotNull()
    contradicts = F.coalesce(F.col("pa.mosaic") != F.col("pb.mosaic"), F.lit(False)) | (
        complete & F.coalesce(far("row") | far("col"), F.lit(False))
    )
    return both.where(~contradicts).select("id_a", "id_b", "similarity")


def groups(pairs: DataFrame) -> DataFrame:
    """(id, group_id, links): the near-duplicate group of every id that has a pair, and its number of pairs."""
    roots = components(pairs, "id_a", "id_b")
    links = pairs.select(F.explode(F.array("id_a", "id_b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    return roots.join(links, "node").select(F.col("node").alias("id"), F.col("root").alias("group_id"), "links")
