"""Array expressions: distances, norms and normalisations (rows V1-V8, P8-P17, P25, P28, P30, P32).

All are Column functions that stay in the JVM.  A vector is an array of numbers, taken as doubles.  A
null vector gives null; a null component makes a sum null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean and standard deviation of each preset.
PRESETS = {
    "imagenet": (0.45, 0.225),
    "mean05std05": (0.5, 0.5),
    "mean05std0225": (0.5, 0.225),
    "meanstdLoTSS": (2e-5, 0.003),
}


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, where a lambda would compute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a vector has no length."""
    return let(norm(a) * norm(b), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def distance(a: Column, b: Column, kind: str = "l2") -> Column:
    """``l2``: squared Euclidean; ``cos``: 2 - 2 a.b of unit vectors."""
    if kind == "l2":
        return squared_l2(a, b)
    if kind == "cos":
        return 2 - 2 * dot(a, b)
    raise ValueError(f"unknown distance {kind!r}")


def l2_normalised(v: Column) -> Column:
    return let(norm(v), lambda n: F.transform(doubles(v), lambda x: x / F.when(n == 0, F.lit(1e-10)).otherwise(n)))


def min_max(v: Column) -> Column:
    """Values from 0 to 1 within the row, all 0 if they are equal."""

    def scaled(s: Column) -> Column:
        low, high = s["low"], s["high"]
        return F.transform(s["v"], lambda x: F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.0)))

    return let(doubles(v), lambda d: let(F.struct(d.alias("v"), F.array_min(d).alias("low"), F.array_max(d).alias("high")), scaled))


def preset(v: Column, name: str) -> Column:
    """Mean and deviation of a preset; an unknown one means min-max."""
    if name not in PRESETS:
        return min_max(v)
    mean, std = PRESETS[name]
    return F.transform(doubles(v), lambda x: (x - mean) / std)


def mean(v: Column) -> Column:
    return total(doubles(v)) / F.size(v)


def std(v: Column) -> Column:
    """Population standard deviation."""
    return let(mean(v), lambda m: F.sqrt(total(F.transform(doubles(v), lambda x: (x - m) * (x - m))) / F.size(v)))


def standardised(v: Column) -> Column:
    both = F.struct(mean(v).alias("m"), std(v).alias("s"))
    return let(both, lambda b: F.transform(doubles(v), lambda x: (x - b["m"]) / (b["s"] + 1e-6)))


def log_stretched(v: Column, k: float = 500.0) -> Column:
    return min_max(let(F.array_min(doubles(v)), lambda low: F.transform(doubles(v), lambda x: F.log1p(k * (x - low)))))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def log1p_finite(v: Column) -> Column:
    """log1p with what isn't finite replaced: +inf by the greatest finite value, the rest by the least."""
    logs = F.transform(doubles(v), lambda x: F.when(x > -1, F.log1p(x)).otherwise(F.when(x == -1, float("-inf")).otherwise(float("nan"))))

    def replaced(s: Column) -> Column:
        low, high = F.coalesce(s["low"], F.lit(0.0)), F.coalesce(s["high"], F.lit(0.0))
        return F.transform(s["v"], lambda x: F.when(finite(x), x).when(x == float("inf"), high).otherwise(low))

    def ends(v: Column) -> Column:
        good = F.filter(v, finite)
        return F.struct(v.alias("v"), F.array_min(good).alias("low"), F.array_max(good).alias("high"))

    return let(logs, lambda v: let(ends(v), replaced))


def sparsity(v: Column) -> Column:
    """Share of components that are zero."""
    return F.size(F.filter(doubles(v), lambda x: x == 0)) / F.size(v)


def grey_levels(v: Column) -> Column:
    """Whole numbers from 0 to 255."""
    return F.transform(min_max(v), lambda x: F.floor(x * 255).cast("int"))


def encoded_levels(levels: Column) -> Column:
    """The grey levels as bytes in base64; a null level gives null."""
    digits = F.transform(levels, lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0"))
    return F.when(~F.exists(levels, lambda x: x.isNull()), F.translate(F.base64(F.unhex(F.array_join(digits, ""))), "\r\n", ""))


def resized(v: Column, height: Column, width: Column, to_height: int, to_width: int) -> Column:
    """P10: a flattened image of height lines, resampled by linear interpolation between the centres of pixels; null
    where the number of values is not height times width."""

    def places(n: Column, to: int) -> Column:
        """(low, high, part) of each new pixel's place among ``n`` old ones."""

        def one(k: Column) -> Column:
            at = F.greatest(F.lit(0.0), F.least((k + 0.5) * n / F.lit(float(to)) - 0.5, (n - 1).cast("double")))
            return F.struct(F.floor(at).cast("int").alias("low"), F.least(F.floor(at) + 1, n - 1).cast("int").alias("high"), (at - F.floor(at)).alias("part"))

        return F.transform(F.sequence(F.lit(0), F.lit(to - 1)), one)

    def pixel(r: Column, c: Column) -> Column:
        def at(row: Column, col: Column) -> Column:
            return F.get(v, row * width + col)

        upper = at(r["low"], c["low"]) * (1 - c["part"]) + at(r["low"], c["high"]) * c["part"]
        lower = at(r["high"], c["low"]) * (1 - c["part"]) + at(r["high"], c["high"]) * c["part"]
        return upper * (1 - r["part"]) + lower * r["part"]

    rows, cols = places(height, to_height), places(width, to_width)
    out = F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: pixel(r, c))))
    return F.when((F.size(v) == height * width) & (height > 0) & (width > 0), out)


def channels(v: Column, n: int = 3) -> Column:
    """The row repeated as ``n`` channels, one after the other."""
    return F.flatten(F.array_repeat(v, n))


def leading_token(v: Column, tokens: int) -> Column:
    """The first of ``tokens`` equal parts of a flattened token matrix."""
    return F.slice(v, F.lit(1), (F.size(v) / tokens).cast("int"))


def group_means(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): component-wise mean of each group's vectors."""
    long = df.select(group, F.posexplode(doubles(F.col(vector))).alias("pos", "x"))
    cells = long.groupBy(group, "pos").agg(F.avg("x").alias("x"))
    return cells.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid")
    )


def group_cosines(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Cosine of every ordered pair of group means (group_a, group_b, similarity)."""
    means = group_means(df, group, vector)
    a = means.select(F.col(group).alias("group_a"), F.col("centroid").alias("ca"))
    b = means.select(F.col(group).alias("group_b"), F.col("centroid").alias("cb"))
    # every group against every group is what is asked for; the groups are few
    return a.join(b, F.lit(True)).select("group_a", "group_b", cosine(F.col("ca"), F.col("cb")).alias("similarity"))
