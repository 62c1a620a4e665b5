"""Order statistics of whole tables without a sort of all rows or a task with all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.functions.draws import draw_order

#: Rows that one sort may hold.
FEW = 100_000


def smallest_number(rows: DataFrame, number: Column, n: int, few: int = FEW) -> tuple[float, float, int]:
    """(low, high, below): the ``n`` rows of the smallest ``number`` are the ``below`` rows up to low, and n - below
    of the rows above low up to high, of which there are about ``few`` at most, or all equal ones.

    Two percentiles bound the last number, closer each time."""
    total = rows.count()
    low, high, below, upto = float("-inf"), float("inf"), 0, total
    while n < total and upto - below > few:
        band = rows.where((number > low) & (number <= high))
        share, margin = (n - below) / (upto - below), 0.002
        ends = band.agg(F.percentile_approx(number, [max(0.0, share - margin), min(1.0, share + margin)], 10_000).alias("q")).first()["q"]
        counts = band.agg(F.count_if(number <= ends[0]), F.count_if(number <= ends[1])).first()
        first, second = below + counts[0], below + counts[1]
        before = upto - below
        if second < n:
            low, below = ends[1], second
        elif first >= n:
            high, upto = ends[0], first
        else:
            low, high, below, upto = ends[0], ends[1], first, second
        if upto - below == before:
            break  # equal numbers
    return low, high, below


def drawn(ids: DataFrame, n: int, seed: int | str, *keys: str) -> DataFrame:
    """The first ``n`` rows in the seeded order of the keys, all if there are fewer.

    The order of the draw is narrowed by its first 52 bits, so that only few rows are sorted, however many
    are drawn.
    """
    order = draw_order(seed, *(F.col(k) for k in keys))
    number = F.conv(F.substring(order, 1, 13), 16, 10).cast("double")
    low, high, below = smallest_number(ids, number, n)
    last = ids.where((number > low) & (number <= high)).orderBy(order, *keys).limit(max(0, n - below))
    return last if not below else ids.where(number <= low).unionAll(last)


def quantiles(rows: DataFrame, value: str, shares: list[float], by: list[str] | None = None, margin: float = 1e-4) -> DataFrame:
    """(by, q0, q1, ...): exact quantiles, between two values by linear interpolation, nulls left out.

    Approximate quantiles bound a band around each exact one, and the nearest value on either side widens it; of
    a band the distinct values are counted and ranked, so a group of any size is never gathered.
    """
    by = by or []
    values = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    ends = F.array(*(F.lit(max(0.0, min(1.0, s + d))) for s in shares for d in (-margin, margin)))
    bounds = values.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("v", ends, 100_000).alias("e"))
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), F.get("e", F.lit(2 * k)).alias("lo"), F.get("e", F.lit(2 * k + 1)).alias("hi")) for k, s in enumerate(shares))))
    bounds = bounds.select(*by, "n", at.alias("b")).select(*by, "n", "b.*")

    def against(ends: DataFrame) -> DataFrame:
        return values.join(ends, by) if by else values.join(F.broadcast(ends), F.lit(True))  # as many rows as shares

    # the exact place may be beside the approximate ones: one more value on either side
    before, after = F.max(F.when(F.col("v") < F.col("lo"), F.col("v"))), F.min(F.when(F.col("v") > F.col("hi"), F.col("v")))
    wider = against(bounds).groupBy(*by, "k", "s", "n", "lo", "hi").agg(before.alias("before"), after.alias("after"))
    wider = wider.select(*by, "k", "s", "n", F.coalesce("before", "lo").alias("lo"), F.coalesce("after", "hi").alias("hi"))
    both = against(wider)
    counts = both.groupBy(*by, "k", "s", "n", "lo", "hi").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"))
    cells = both.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).groupBy(*by, "k", "v").agg(F.count("*").alias("c"))
    w = W.partitionBy(*by, "k").orderBy("v")
    upto = cells.withColumn("upto", F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0))).join(counts, [*by, "k"])
    place = F.col("s") * (F.col("n") - 1)

    def nth(rank: Column) -> Column:
        """The value whose rows cover the rank, counted from 0."""
        return F.min(F.when(F.col("upto") + F.col("below") > rank, F.col("v")))

    found = upto.groupBy(*by, "k").agg(nth(F.floor(place)).alias("low"), nth(F.ceil(place)).alias("high"), F.first(place - F.floor(place)).alias("part"))
    exact = F.col("low") + F.col("part") * (F.col("high") - F.col("low"))
    out = found.groupBy(*by) if by else found.groupBy()
    return out.agg(*(F.max(F.when(F.col("k") == k, exact)).alias(f"q{k}") for k in range(len(shares))))


def numbered(rows: DataFrame, *order: str, name: str = "new_id") -> DataFrame:
    """Dense numbers from 0 in the given order, without gathering the rows in one partition."""
    return accumulated(rows.withColumn("_one", F.lit(1).cast("long")), "_one", *order, name=name).drop("_one")


def accumulated(rows: DataFrame, amount: str, *order: str, name: str) -> DataFrame:
    """The rows with the sum of ``amount`` (whole numbers, no nulls) over all rows before each in the given order.

    The rows are range partitioned and sorted; a partition's offset is the sum of the ones before it, and only
    the sums of the partitions go to the driver.
    """
    from winnow.functions.lineage import cut

    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("_part", F.shiftright("_place", 33)))
    sums = sorted((r[0], r[1]) for r in placed.groupBy("_part").agg(F.sum(amount)).collect())
    offsets, before = [], 0
    for part, total in sums:
        offsets += [F.lit(part), F.lit(int(before))]
        before += total
    inside = F.coalesce(F.sum(amount).over(W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offset = F.element_at(F.create_map(*offsets), F.col("_part")) if offsets else F.lit(0)
    return placed.withColumn(name, (offset + inside).cast("long")).drop("_place", "_part")
