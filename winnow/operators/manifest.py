"""Cutout manifests: windows, filters, merging, neighbours (rows P1-P7, W1, U1-U6, J2-J6, J13, A15, A22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.functions.order import numbered


def step(size: int, overlap: float) -> int:
    return int(size * (1 - overlap))


def windows(mosaics: DataFrame, size: int, overlap: float = 0.5) -> DataFrame:
    """(mosaic_name, pos_row, pos_col, file_name) of all windows inside each mosaic.

    A mosaic smaller than the window, or without a size, has none.
    """
    by = step(size, overlap)
    if by < 1:
        raise ValueError("the overlap leaves no step")
    fit = mosaics.where((F.col("height") >= size) & (F.col("width") >= size))
    rows = fit.select("mosaic_name", "width", F.explode(F.sequence(F.lit(0), F.col("height") - size, F.lit(by))).alias("pos_row"))
    cells = rows.select("mosaic_name", "pos_row", F.explode(F.sequence(F.lit(0), F.col("width") - size, F.lit(by))).alias("pos_col"))
    return cells.withColumn("file_name", F.format_string("patch_%d_%d.npy", "pos_row", "pos_col"))


def without_blanks(cells: DataFrame, pixels: DataFrame, size: int, overlap: float = 0.5) -> DataFrame:
    """The windows that hold no blank pixel (value null or NaN).

    A blank lies in the few windows whose start is within ``size`` before it, so it names them and the rest
    is an anti join on equal keys instead of a range join.
    """
    by = step(size, overlap)

    def starts(at: str):
        first = F.greatest(F.lit(0), F.ceil((F.col(at) - size + 1) / by).cast("int"))
        return F.explode(F.sequence(first * by, F.floor(F.col(at) / by).cast("int") * by, F.lit(by)))

    blank = pixels.where(F.col("value").isNull() | F.isnan("value"))
    hit = blank.select("mosaic_name", "col", starts("row").alias("pos_row")).select("mosaic_name", "pos_row", starts("col").alias("pos_col"))
    return cells.join(hit.distinct(), ["mosaic_name", "pos_row", "pos_col"], "left_anti")


def non_overlapping(entries: DataFrame, per_mosaic: bool = False) -> DataFrame:
    """Entries (id, mosaic_name, pos_row, pos_col, size) on the grid of the entry of the smallest id.

    Kept are those whose distance from it is a multiple of its size in both directions.  With
    ``per_mosaic`` every mosaic has its own origin.  Entries without a position are dropped.
    """
    placed = entries.where("pos_row is not null and pos_col is not null")
    origin = F.min_by(F.struct(F.col("pos_row").alias("r"), F.col("pos_col").alias("c"), F.col("size").alias("s")), F.col("id")).alias("o")
    usable = placed.where("size > 0")
    if per_mosaic:
        both = placed.join(usable.groupBy("mosaic_name").agg(origin), "mosaic_name")
    else:
        both = placed.join(F.broadcast(usable.agg(origin)), F.lit(True))  # one row
    on = (F.pmod(F.col("pos_row") - F.col("o.r"), F.col("o.s")) == 0) & (F.pmod(F.col("pos_col") - F.col("o.c"), F.col("o.s")) == 0)
    return both.where(on).select(*entries.columns)


def merged(manifests: list[DataFrame]) -> DataFrame:
    """All rows of the manifests in the order of the arguments, then of their ids, renumbered from 0."""
    tagged = [m.withColumn("source_ord", F.lit(k)) for k, m in enumerate(manifests)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return numbered(out, "source_ord", "id")


def neighbours(entries: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """(id, neighbor_id) of entries of one mosaic that lie at one of the offsets from each other."""
    shift = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets)))
    near = entries.select("id", "mosaic_name", "pos_row", "pos_col", shift.alias("o")).select(
        "id", "mosaic_name", (F.col("pos_row") + F.col("o.r")).alias("pos_row"), (F.col("pos_col") + F.col("o.c")).alias("pos_col")
    )
    other = entries.select(F.col("id").alias("neighbor_id"), "mosaic_name", "pos_row", "pos_col")
    return near.join(other, ["mosaic_name", "pos_row", "pos_col"]).where("id <> neighbor_id").select("id", "neighbor_id")


def four(row: int, col: int) -> list[tuple[int, int]]:
    return [(0, -col), (0, col), (-row, 0), (row, 0)]


def diagonal(row: int, col: int) -> list[tuple[int, int]]:
    return [(-row, -col), (-row, col), (row, -col), (row, col)]


def eight(by: int) -> list[tuple[int, int]]:
    return four(by, by) + diagonal(by, by)


def unordered(pairs: DataFrame, a: str = "id", b: str = "neighbor_id") -> DataFrame:
    """Each unordered pair once."""
    return pairs.select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")).distinct()


def cluster_pairs(entries: DataFrame, offsets: list[tuple[int, int]], assignment: DataFrame) -> DataFrame:
    """(cluster_id, pairs) of unordered neighbour pairs whose ends are in one cluster; 0 where there are none.

    The cluster is on the entries before they meet, so pairs of two clusters never arise."""
    known = entries.select("id", "mosaic_name", "pos_row", "pos_col").join(assignment.select("id", "cluster_id"), "id")
    shift = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets)))
    near = known.select("id", "cluster_id", "mosaic_name", "pos_row", "pos_col", shift.alias("o")).select(
        "id", "cluster_id", "mosaic_name", (F.col("pos_row") + F.col("o.r")).alias("pos_row"), (F.col("pos_col") + F.col("o.c")).alias("pos_col")
    )
    other = known.select(F.col("id").alias("neighbor_id"), "cluster_id", "mosaic_name", "pos_row", "pos_col")
    both = near.join(other, ["mosaic_name", "pos_row", "pos_col", "cluster_id"]).where("id <> neighbor_id")
    pairs = both.select("cluster_id", F.least("id", "neighbor_id").alias("id_a"), F.greatest("id", "neighbor_id").alias("id_b")).distinct()
    inside = pairs.groupBy("cluster_id").agg(F.count("*").alias("pairs"))
    return assignment.select("cluster_id").distinct().join(inside, "cluster_id", "left").select("cluster_id", F.coalesce("pairs", F.lit(0)).alias("pairs"))


def pair_statistics(counts: DataFrame) -> DataFrame:
    """Mean, greatest and least number of pairs over the clusters."""
    return counts.agg(F.avg("pairs").alias("mean_pairs"), F.max("pairs").alias("max_pairs"), F.min("pairs").alias("min_pairs"))


def gathered(rows: DataFrame, index: DataFrame) -> DataFrame:
    """P5: the rows at the ids of an index (position, id), in its order, repeats kept."""
    return index.join(rows, "id").orderBy("position")


def index_report(index: DataFrame, size: int) -> DataFrame:
    """Of text entries of an index: how many there are, how many are whole numbers in 0..size-1."""
    number = F.expr("try_cast(entry AS BIGINT)")
    good = number.isNotNull() & number.between(0, size - 1)
    return index.agg(F.count("*").alias("entries"), F.count_if(good).alias("valid"), F.count_if(~F.coalesce(good, F.lit(False))).alias("dropped"))


def valid_index(index: DataFrame, size: int) -> DataFrame:
    """The entries that are whole numbers in 0..size-1, positions kept."""
    return index.select("position", F.expr("try_cast(entry AS BIGINT)").alias("id")).where(F.col("id").between(0, size - 1))


def alignment(features: DataFrame, manifest: DataFrame) -> DataFrame:
    """(problem, n) of ids that only one side has, or whose paths differ."""
    f = features.select("id", F.col("file_path").alias("fp")).groupBy("id").agg(F.min("fp").alias("fp"), F.lit(1).alias("f"))
    m = manifest.select("id", F.col("file_path").alias("mp")).groupBy("id").agg(F.min("mp").alias("mp"), F.lit(1).alias("m"))
    problem = (
        F.when(F.col("f").isNull(), "no feature").when(F.col("m").isNull(), "no cutout").when(~F.col("fp").eqNullSafe(F.col("mp")), "paths differ").otherwise("aligned")
    )
    return f.join(m, "id", "full_outer").groupBy(problem.alias("problem")).agg(F.count("*").alias("n"))
