"""Balanced hierarchical sampling and other draws (rows M1-M16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.functions.draws import draw_order, uniform
from winnow.functions.order import accumulated, drawn, numbered
from winnow.functions.partitions import small


def _with_cut(children: DataFrame) -> DataFrame:
    """The children with the cut of their parent, from one sort by parent and size."""
    w = W.partitionBy("parent_id").orderBy("a", "child_id")
    everyone = W.partitionBy("parent_id")
    before = F.coalesce(F.sum("a").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.count("*").over(everyone) - F.row_number().over(w) + 1
    steps = children.withColumns({"_before": before, "_left": left})
    tight = F.when(F.expr("_before + _left * a > target"), F.struct("_before", F.expr("(target - _before) div _left").alias("level")))
    cut = F.when(F.sum("a").over(everyone) <= F.col("target"), F.max("a").over(everyone)).otherwise(F.min(tight).over(everyone)["level"])
    return steps.withColumn("cut", cut.cast("long")).drop("_before", "_left")


def cuts(children: DataFrame) -> DataFrame:
    """M1: (parent_id, target, cut) of ``children`` (parent_id, child_id, a, target).

    The cut is the largest whole x for which the sum of min(x, a) stays within the target, or the
    greatest a if the sum of all does.  With a ascending and P the sum before, it is
    (target - P) / (number left), rounded down, at the first a that would not fit for all that are left.
    """
    return _with_cut(children).groupBy("parent_id", "target").agg(F.first("cut").alias("cut"))


def allocations(children: DataFrame, seed: int) -> DataFrame:
    """M4: (parent_id, child_id, a, quota): min(cut, a) each, and one more for as many larger children as are
    needed to reach the target, in a seeded order.  The sum is the target, or all if that is less."""
    base = F.least("cut", "a")
    w = W.partitionBy("parent_id")
    rest = F.least(F.col("target"), F.sum("a").over(w)) - F.sum(base).over(w)
    larger = (F.col("a") > F.col("cut")).cast("int")
    turn = F.row_number().over(w.orderBy(F.desc(larger), draw_order(seed, F.col("child_id")), "child_id"))
    quota = base + F.when((larger == 1) & (turn <= rest), 1).otherwise(0)
    return _with_cut(children).select("parent_id", "child_id", "a", quota.cast("long").alias("quota"))


def hierarchical_sample(
    edges: DataFrame, flat_sizes: DataFrame, levels: int, target: int, multiplier: int = 1, strategy: str = "r", seed: int = 0
) -> DataFrame:
    """M5/M6: (id, replica) with ``target`` rows, balanced over the clusters of each level from the top.

    ``edges`` is (level, parent_id, child_id) with, at level 1, the rank of the child in its cluster in
    ``rank_in_cluster``; ``flat_sizes`` is (level, cluster_id, flat_size).  A point is taken up to
    ``multiplier`` times.  Strategy r takes the remainder of a cluster at random, c the closest.
    """
    if strategy not in ("r", "c"):
        raise ValueError(f"unknown strategy {strategy!r}")
    sized = flat_sizes.select("level", "cluster_id", (F.col("flat_size") * multiplier).cast("long").alias("a"))
    top = sized.where(F.col("level") == levels).select(
        F.lit(-1).cast("long").alias("parent_id"), F.col("cluster_id").alias("child_id"), "a", F.lit(target).cast("long").alias("target")
    )
    now = allocations(top, seed).select(F.col("child_id").alias("cluster_id"), "quota")
    for level in range(levels, 1, -1):
        up = edges.where(F.col("level") == level).select("parent_id", "child_id")
        below = sized.where(F.col("level") == level - 1).select(F.col("cluster_id").alias("child_id"), "a")
        children = up.join(now, up["parent_id"] == now["cluster_id"]).join(below, "child_id").select(
            "parent_id", "child_id", "a", F.col("quota").alias("target")
        )
        now = allocations(children, seed).select(F.col("child_id").alias("cluster_id"), "quota")
    points = edges.where("level = 1").select(F.col("parent_id").alias("cluster_id"), F.col("child_id").alias("id"), "rank_in_cluster")
    sizes = flat_sizes.where("level = 1 and flat_size > 0").select("cluster_id", F.col("flat_size").alias("flat_size"))
    drawn_ = points.join(now.join(sizes, "cluster_id"), "cluster_id")
    if strategy == "c":
        drawn_ = drawn_.withColumn("turn", F.row_number().over(W.partitionBy("cluster_id").orderBy("rank_in_cluster", "id")))
    else:
        drawn_ = _turns(drawn_, multiplier, seed)
    whole = F.least(F.expr("quota div flat_size"), F.lit(multiplier))
    extra = F.when((whole < multiplier) & (F.col("turn") <= F.expr("quota % flat_size")), 1).otherwise(0)
    times = (whole + extra).cast("int")
    return drawn_.where(times > 0).select("id", F.explode(F.sequence(F.lit(0), times - 1)).alias("replica"))


def _turns(points: DataFrame, multiplier: int, seed: int) -> DataFrame:
    """The points with their turn in the seeded order of their cluster, as far as a turn may matter.

    Of a cluster that gives ``rest`` of its points once more, only those whose draw is below about rest / size are
    ranked, with so much to spare that more than ``rest`` remain; should they not, the job fails.  So what
    is sorted is about as much as is drawn, however large a cluster is.  The others get a turn beyond all.
    """
    rest, size = F.expr("try_mod(quota, flat_size)"), F.expr("nullif(flat_size, 0)")
    all_ = F.expr("quota div nullif(flat_size, 0)") >= multiplier
    near = F.coalesce(F.when(all_ | (rest == 0), F.lit(False)).otherwise(uniform(seed, F.col("id")) <= (1.5 * rest + 64) / size), F.lit(False))
    marked_ = points.withColumn("_near", near)
    w = W.partitionBy("cluster_id").orderBy(draw_order(seed, F.col("id")), "id")
    ranked = marked_.where("_near").withColumns({"turn": F.row_number().over(w), "_n": F.count("*").over(W.partitionBy("cluster_id"))})
    enough = F.when(F.col("_n") < F.least(rest, size), F.raise_error(F.lit("a draw left too few points of a cluster"))).otherwise(F.col("turn"))
    others = marked_.where("not _near").withColumn("turn", F.lit(2**31 - 1))
    return ranked.withColumn("turn", enough).drop("_n", "_near").unionByName(others.drop("_near"))


def per_cluster(assignment: DataFrame, n: int, seed: int) -> DataFrame:
    """M2: min(n, size) ids of each cluster without replacement."""
    w = W.partitionBy("cluster_id").orderBy(draw_order(seed, F.col("id")), "id")
    return assignment.select("cluster_id", "id").withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)


def flat(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """M8: n ids, or all if there are fewer."""
    return drawn(ids.select("id"), n, seed, "id")


def fraction(ids: DataFrame, share: int, seed: int) -> DataFrame:
    """M9: one in ``share`` ids, at least one."""
    return flat(ids, max(1, ids.count() // share), seed)


def equalised(a: DataFrame, b: DataFrame, seed: int) -> DataFrame:
    """Both sets cut to the smaller one's size, tagged by ``side``."""
    n = min(a.count(), b.count())
    return flat(a, n, seed).withColumn("side", F.lit("a")).unionAll(flat(b, n, seed).withColumn("side", F.lit("b")))


def random_pairs(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """Up to n distinct unordered pairs of different ids, drawn by two seeded orders of equal ranks."""

    def order(name: str) -> DataFrame:
        few = drawn(ids.select(F.col("id").alias(name)), n, f"{seed}|{name}", name)
        return numbered(few.withColumn("_order", draw_order(f"{seed}|{name}", F.col(name))), "_order", name, name="rn").select("rn", name)

    both = order("x").join(order("y"), "rn").where("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def some_pairs(pairs: DataFrame, n: int, seed: int) -> DataFrame:
    """N of the given pairs (id_a, id_b) in a seeded order."""
    return drawn(pairs.select("id_a", "id_b"), n, seed, "id_a", "id_b")


def marked(members: DataFrame, sample: DataFrame) -> DataFrame:
    """(id, is_sampled) of the members."""
    hit = sample.select("id").distinct().withColumn("_hit", F.lit(True))
    return members.select("id").join(hit, "id", "left").select("id", F.coalesce("_hit", F.lit(False)).alias("is_sampled"))


def running_draws(weights: DataFrame, draws: DataFrame, key: str = "cluster_id", weight: str = "flat_size") -> DataFrame:
    """(draw, key) for each of ``draws`` (draw, u): the first key whose running share of the weights, in order of
    the keys, reaches u.  Weights are whole numbers; without any there is no row."""
    run = accumulated(weights.select(key, weight).where(F.col(weight) > 0), weight, key, name="_before")
    total = weights.agg(F.sum(weight)).first()[0]
    if not total:
        return draws.select("draw", F.lit(None).cast(weights.schema[key].dataType).alias(key)).limit(0)
    ends = run.select(key, (F.col("_before") / F.lit(float(total))).alias("lo"), ((F.col("_before") + F.col(weight)) / F.lit(float(total))).alias("hi"))
    at = (F.col("u") <= F.col("hi")) & ((F.col("u") > F.col("lo")) | (F.col("lo") == 0))
    return ends.join(small(draws), at).groupBy("draw").agg(F.min(key).alias(key))


def preview(members: DataFrame, sampled: DataFrame, n: int = 3) -> DataFrame:
    """Of each cluster all members if there are at most 2n, else the first n sampled and n others."""
    flagged = members.join(sampled.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left").withColumn(
        "is_sampled", F.col("hit").isNotNull()
    )
    size = F.count("*").over(W.partitionBy("cluster_id"))
    rank = F.row_number().over(W.partitionBy("cluster_id", "is_sampled").orderBy("rank_in_cluster", "id"))
    return flagged.withColumn("size", size).withColumn("rn", rank).where((F.col("size") <= 2 * n) | (F.col("rn") <= n)).select(
        "cluster_id", "id", "is_sampled"
    )


def background(ids: DataFrame, current: int, n: int, seed: int) -> DataFrame:
    """N random ids and the current one."""
    return flat(ids, n, seed).unionAll(ids.select("id").where(F.col("id") == current)).distinct()


def spot_check(ids: DataFrame, seed: int, n: int = 3) -> DataFrame:
    """The first, the last and n random ids."""
    ends = ids.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).select(F.explode(F.array("lo", "hi")).alias("id"))
    return ends.where("id is not null").unionAll(flat(ids, n, seed)).distinct()


def remapped(sample: DataFrame, valid: DataFrame) -> DataFrame:
    """Ordinals of a subset back to its ids; ``valid`` is the subset, its ordinals in order of id."""
    ordinals = numbered(valid.select("id"), "id", name="ordinal")
    return sample.join(ordinals, "ordinal").select("id", "replica")


def configurations(n: int, levels: int, seed: int, spark) -> DataFrame:
    """Seeded random clustering configurations (config_id, k, r, m), arrays over the levels."""
    def number(name: str, low: int, high: int) -> Column:
        return F.array(
            *(
                (F.lit(low) + F.conv(F.substring(draw_order(f"{seed}|{name}|{j}", F.col("config_id")), 1, 8), 16, 10).cast("long") % (high - low + 1))
                for j in range(levels)
            )
        )

    return spark.range(n).select(
        F.col("id").alias("config_id")
    ).select("config_id", number("k", 50, 5000).alias("k"), number("r", 0, 10).alias("r"), number("m", 2, 30).alias("m"))


def resampled_images(k: Column, r: Column, m: Column) -> Column:
    """Sum over the levels of k * r * m."""
    return F.aggregate(F.arrays_zip(k.alias("k"), r.alias("r"), m.alias("m")), F.lit(0).cast("long"), lambda s, x: s + x["k"] * x["r"] * x["m"])


def nearest_to_total(configs: DataFrame, total: int, n: int) -> DataFrame:
    """L4: the n configurations whose number of images is nearest to a total."""
    images = configs.withColumn("images", resampled_images(F.col("k"), F.col("r"), F.col("m")))
    return images.orderBy(F.abs(F.col("images") - total), "config_id").limit(n)
