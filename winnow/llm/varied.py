"""Choosing a varied subset (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.functions.lineage import cut
from winnow.llm.near_duplicates import mosaic_key
from winnow.llm.packs import unit, usable

#: Tables of the hash, and the fewest bits of each.
TABLES, BITS = 8, 16
#: Requests that one pass over the candidates serves.
TOGETHER = 32


def _buckets(x: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of each vector in each table, numbered through all tables."""
    signs = (unit(x).astype(np.float32) @ planes > 0).reshape(len(x), TABLES, bits)
    return signs @ (1 << np.arange(bits)) + (np.arange(TABLES) << bits)


def densities(df: DataFrame, dim: int = 64, seed: int = 11, ids: str = "id", vectors: str = "embedding") -> DataFrame:
    """(id, density) of every usable vector: the mean number of vectors that share its bucket.

    Vectors alike fall into one bucket of a table of sign hashes with a probability that grows with their
    cosine, so the mean count over repeated tables estimates how many vectors are near.  A table has as many
    bits as the number of rows, so a vector without any near ones meets about one by chance, whatever the number.
    The counts are over all rows; they are aggregated before they are shuffled, and stay distributed: vectors
    and counts meet by bucket, and of a bucket of one vector nothing needs to be looked up.  Rows that were
    delivered twice count twice.
    """
    bits = max(BITS, ceil(log2(max(2, df.select(ids).count()))))

    def planes() -> np.ndarray:
        return np.random.default_rng(seed).standard_normal((dim, TABLES * bits)).astype(np.float32)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = planes()
        for batch in batches:
            i, x = usable(batch, dim, ids, vectors)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, TABLES)), pa.array(_buckets(x, p, bits).ravel())], names=["id", "bucket"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = planes()
        for batch in batches:
            _, x = usable(batch, dim, ids, vectors)
            if len(x):
                at, n = np.unique(_buckets(x, p, bits), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["bucket", "n"])

    few = df.select(ids, vectors)
    counts = few.mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1")
    met = few.mapInArrow(hashed, "id long, bucket long").join(counts, "bucket", "left")
    return met.groupBy("id").agg(F.avg(F.coalesce("n", F.lit(1))).alias("density"))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on nothing but the parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def varied_subset(
    features: DataFrame,
    records: DataFrame,
    requests: DataFrame,
    dim: int = 64,
    seed: int = 11,
    group_power: float = 0.5,
) -> DataFrame:
    """(request_id, id, replica, weight) for each row of ``requests`` (request_id, target_size, multiplier).

    The candidates are the ids of ``records`` (id, mosaic_name) that have a usable vector in ``features``.
    A candidate's weight is 1 / density, divided by the size of its mosaic to the power ``group_power`` and
    scaled to the mean 1, and a request takes the ``target_size`` candidates of the smallest -log(u) / weight,
    a weighted draw without replacement.  So groups of similar vectors count about alike however large
    they are, and a mosaic with a tenth of the rows doesn't bring a tenth of the subset.

    Defined cases: a target beyond ``multiplier`` times the candidates gives every candidate that often;
    beyond their number, every candidate once and the rest by weight again, replica counting the turns;
    a null or negative target gives nothing, a null multiplier is 1; ids given twice count once; a null
    or digitless mosaic name is a mosaic of its own; u depends on the request and the id only, so the
    draw is repeatable; empty tables give an empty result; other columns are ignored.  A request's
    sampling_strategy, which says how to draw from a cluster, has no meaning here, as there are none: each
    request is a weighted draw.  Requests are collected; each needs a column of the pass that serves it.
    """
    dense = densities(features, dim, seed)
    named = records.where("id is not null").groupBy("id").agg(F.max(mosaic_key(F.col("mosaic_name"))).alias("mosaic"))
    both = cut(dense.join(named, "id"))
    sizes = both.groupBy("mosaic").agg(F.count("*").alias("mosaic_rows"))
    sizes = F.broadcast(sizes) if sizes.count() <= 200_000 else sizes
    weighted = both.join(sizes, both["mosaic"].eqNullSafe(sizes["mosaic"]))
    weighted = weighted.select(
        "id", (1 / F.col("density") / F.pow(F.col("mosaic_rows"), F.lit(group_power))).alias("weight")
    )
    total, mean = weighted.agg(F.count("*"), F.avg("weight")).first()
    weighted = cut(weighted.select("id", (F.col("weight") / F.lit(mean or 1.0)).alias("weight")))
    wanted = [
        (r["request_id"], min(int(r["target_size"]), total * max(1, int(r["multiplier"] or 1))))
        for r in requests.select("request_id", "target_size", "multiplier").collect()
        if r["target_size"] is not None and r["target_size"] > 0
    ]
    schema = "request_id int, id long, replica int, weight double"
    out = features.sparkSession.createDataFrame([], schema)
    for at in range(0, len(wanted) if total else 0, TOGETHER):
        some = wanted[at : at + TOGETHER]
        whole = [(request, size // total) for request, size in some if size >= total]
        if whole:
            turns = F.array(*(F.struct(F.lit(r).cast("int").alias("request_id"), F.lit(n).alias("turns")) for r, n in whole))
            each = weighted.select("id", "weight", F.explode(turns).alias("x"))
            replica = F.explode(F.sequence(F.lit(0), (F.col("x.turns") - 1).cast("int"))).alias("replica")
            out = out.unionAll(each.select("x.request_id", "id", replica, "weight"))
        rest = [(request, size // total, size % total) for request, size in some if size % total]
        if rest:
            keys = [-F.log(uniform(F.lit(seed), F.lit(r), F.col("id"))) / F.col("weight") for r, _, _ in rest]
            out = out.unionAll(_smallest(weighted, rest, keys, total))
    return out


def _smallest(weighted: DataFrame, wanted: list[tuple[int, int, int]], keys: list[Column], total: int, exact: int = 50_000) -> DataFrame:
    """(request_id, id, replica, weight): for each (request, replica, size) the ``size`` rows of the smallest
    (key, id) of ``total``, fewer than all.

    Two percentiles bound the last key of each request from below and above, closer each time, until few rows
    lie between; only these are sorted, and those below the lower bound are taken as they are.  All
    requests share the passes.
    """
    state = [{"low": float("-inf"), "high": float("inf"), "below": 0, "upto": total, "open": True} for _ in wanted]
    while True:
        at = [n for n, s in enumerate(state) if s["open"] and s["upto"] - s["below"] > exact]
        if not at:
            break
        ends = []
        for n in at:
            s = state[n]
            share, margin = (wanted[n][2] - s["below"]) / (s["upto"] - s["below"]), 0.002
            inside = F.when((keys[n] > s["low"]) & (keys[n] <= s["high"]), keys[n])
            ends.append(F.percentile_approx(inside, [max(0.0, share - margin), min(1.0, share + margin)], 10_000).alias(f"q{n}"))
        q = weighted.agg(*ends).first()
        n_upto = weighted.agg(*(F.count_if(keys[n] <= q[f"q{n}"][k]).alias(f"n{n}_{k}") for n in at for k in (0, 1))).first()
        for n in at:
            s, size = state[n], wanted[n][2]
            (low, high), (n_low, n_high) = q[f"q{n}"], (n_upto[f"n{n}_{k}"] for k in (0, 1))
            before = s["upto"] - s["below"]
            if n_high < size:
                s["low"], s["below"] = high, n_high
            elif n_low >= size:
                s["high"], s["upto"] = low, n_low
            else:
                s["low"], s["high"], s["below"], s["upto"] = low, high, n_low, n_high
            s["open"] = s["upto"] - s["below"] < before  # else equal keys
    entries = [
        F.struct(F.lit(r).cast("int").alias("request_id"), F.lit(turn).cast("int").alias("replica"), key.alias("key"), (key <= s["low"]).alias("sure"), F.lit(size - s["below"]).alias("left"), (key <= s["high"]).alias("near"))
        for (r, turn, size), key, s in zip(wanted, keys, state, strict=True)
    ]
    rows = weighted.select("id", "weight", F.explode(F.filter(F.array(*entries), lambda e: e["near"])).alias("e")).select("id", "weight", "e.*")
    last = rows.where("not sure").withColumn("place", F.row_number().over(W.partitionBy("request_id", "replica").orderBy("key", "id")))
    columns = ["request_id", "id", "replica", "weight"]
    return rows.where("sure").select(columns).unionAll(last.where("place <= left").select(columns))
