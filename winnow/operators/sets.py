"""Set operations, generators and small views of tables (rows P27, U2, U5, U6, L6, L8, T4, S26)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.draws import uniform


def tagged_union(first: DataFrame, second: DataFrame, tag: str = "src") -> DataFrame:
    """All rows of both with the side they come from, to be split again by it."""
    return first.withColumn(tag, F.lit(0)).unionByName(second.withColumn(tag, F.lit(1)), allowMissingColumns=True)


def with_neighbours(seeds: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ids of the seeds and of their neighbours, each once."""
    near = pairs.join(seeds.select("id"), "id", "left_semi").select(F.col("neighbor_id").alias("id"))
    return seeds.select("id").unionAll(near).distinct()


def concatenated(*samples: DataFrame) -> DataFrame:
    """Samples one after the other, repeats kept."""
    out = samples[0]
    for s in samples[1:]:
        out = out.unionByName(s)
    return out


def gaussian(seed: str, identity: Column) -> Column:
    """A normal number of each id, by Box and Muller from two uniform ones."""
    u, v = uniform(f"{seed}|u", identity), uniform(f"{seed}|v", identity)
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v)


def rings(spark: SparkSession, counts: list[int], seed: int = 0) -> DataFrame:
    """(id, ring, x, y): points on noisy rings around the origin, ring r of radius r + 1."""
    total = sum(counts)
    bounds, before = [], 0
    for n in counts:
        before += n
        bounds.append(before)
    ring = F.lit(0)
    for b in bounds[:-1]:
        ring = ring + F.when(F.col("id") >= b, 1).otherwise(0)
    angle = 2 * math.pi * uniform(f"{seed}|angle", F.col("id"))
    radius = F.col("ring") + 1 + 0.1 * gaussian(f"{seed}|radius", F.col("id"))
    return spark.range(total).withColumn("ring", ring).select("id", "ring", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


def mixture(spark: SparkSession, counts: list[int], centres: list[tuple[float, float]], spread: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, part, x, y): points of normal clouds around the centres."""
    out = None
    for part, (n, (cx, cy)) in enumerate(zip(counts, centres, strict=True)):
        own = spark.range(n).select(
            F.col("id"),
            F.lit(part).alias("part"),
            (cx + spread * gaussian(f"{seed}|{part}|x", F.col("id"))).alias("x"),
            (cy + spread * gaussian(f"{seed}|{part}|y", F.col("id"))).alias("y"),
        )
        out = own if out is None else out.unionAll(own)
    return out


def first_batches(rows: DataFrame, size: int, batches: int, *order: str) -> DataFrame:
    """What the first batches of a given size hold, in an order."""
    return rows.orderBy(*order).limit(size * batches)
