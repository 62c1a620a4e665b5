"""Queries on mosaics, pixels and cutouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions.draws import draw_order
from winnow.operators import manifest as M
from winnow.operators.kmeans import Centroids, assign
from winnow.operators.manifest import diagonal, eight, four
from winnow.operators.statistics import blank_aware, contrast
from winnow.plans.common import CUTOUTS, FEATURES, PIXELS, cutouts, features, pixels, rounded, small_mosaics, table

SIZE = 1024


def proj1_cutout_grid(spark, folder):
    return M.windows(table(spark, folder, "mosaics"), SIZE, 0.5)


def proj2_blank_filter(spark, folder):
    cells = M.windows(small_mosaics(spark, folder), 4, 0.5)
    return M.without_blanks(cells, pixels(spark, folder), 4, 0.5).select("mosaic_name", "pos_row", "pos_col")


def proj4_non_overlap(spark, folder):
    return M.non_overlapping(cutouts(spark, folder)).select("id", "mosaic_name", "pos_row", "pos_col")


def proj4_non_overlap_by_mosaic(spark, folder):
    return M.non_overlapping(cutouts(spark, folder), per_mosaic=True).select("id", "mosaic_name", "pos_row", "pos_col")


def w1_merge_reindex(spark, folder):
    c = cutouts(spark, folder)
    return M.merged([c.where("survey is not null"), c.where("survey is null")]).select("new_id", "source_ord", "id", "file_path")


def _pairs(offsets):
    def query(spark, folder):
        return M.neighbours(cutouts(spark, folder).where("pos_row is not null"), offsets)

    return query


def u3_unordered_pairs(spark, folder):
    return M.unordered(_pairs(eight(128))(spark, folder))


def _assignment(spark, folder):
    f = features(spark, folder)
    first = f.orderBy("id").limit(8).collect()
    import numpy as np

    return assign(f, Centroids(np.arange(len(first)), np.array([r["embedding"] for r in first]).reshape(len(first), -1)))


def j13_cluster_pairs(spark, folder):
    return M.cluster_pairs(cutouts(spark, folder).where("pos_row is not null"), eight(128), _assignment(spark, folder))


def a15_pair_statistics(spark, folder):
    return rounded(M.pair_statistics(j13_cluster_pairs(spark, folder)), "mean_pairs")


def a1_blank_mean_std(spark, folder):
    return rounded(blank_aware(pixels(spark, folder)), "mean", "std")


def proj3_patch_names(spark, folder):
    """The names of the files of a grid's windows."""
    return M.windows(table(spark, folder, "mosaics"), SIZE, 0.5).select("mosaic_name", "file_name")


def proj16_contrast(spark, folder):
    return rounded(contrast(pixels(spark, folder), 0.5), "low", "high")


def a22_counts(spark, folder):
    return cutouts(spark, folder).groupBy("cutout_run").agg(F.count("*").alias("num_cutouts"))


def j2_alignment(spark, folder):
    return M.alignment(table(spark, folder, "features"), table(spark, folder, "cutouts"))


def proj5_gather(spark, folder):
    """Customers at a drawn index in which every entry occurs twice."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    index = c.select(F.col("id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    index = index.select("id", F.md5(F.concat_ws("|", "turn", "id")).alias("position"))
    return M.gathered(c, index).select("position", "id", "c_name")


def _entries(spark, folder):
    return table(spark, folder, "events").select(F.col("event_id").alias("position"), F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.get_json_object("props", "$.k")).alias("entry"))


def proj6_index_report(spark, folder):
    return M.index_report(_entries(spark, folder), 50)


def proj7_valid_index(spark, folder):
    return M.valid_index(_entries(spark, folder), 50)


def proj29_random_crops(spark, folder):
    """A crop for each of the mosaics at a drawn place."""
    h = F.conv(F.substring(draw_order("crop", F.col("mosaic_name")), 1, 8), 16, 10).cast("long")
    w = F.conv(F.substring(draw_order("crop", F.col("mosaic_name")), 9, 8), 16, 10).cast("long")
    m = table(spark, folder, "mosaics").where("height >= 256 and width >= 256")
    return m.select("mosaic_name", (h % (F.col("height") - 255)).alias("pos_row"), (w % (F.col("width") - 255)).alias("pos_col"))


def s23_pixel_slice(spark, folder):
    return rounded(pixels(spark, folder).where("row between 4 and 9 and col between 3 and 8"), "value")


def queries():
    return {
        "proj1_cutout_grid": proj1_cutout_grid,
        "proj2_blank_filter": proj2_blank_filter,
        "proj4_non_overlap": proj4_non_overlap,
        "proj4_non_overlap_by_mosaic": proj4_non_overlap_by_mosaic,
        "w1_merge_reindex": w1_merge_reindex,
        "j3_neighbors4": _pairs(four(256, 128)),
        "j4_neighbors_diag": _pairs(diagonal(256, 128)),
        "j5_neighbors8": _pairs(eight(128)),
        "u3_unordered_pairs": u3_unordered_pairs,
        "j13_cluster_pairs": j13_cluster_pairs,
        "a15_pair_statistics": a15_pair_statistics,
        "a1_blank_mean_std": a1_blank_mean_std,
        "proj3_patch_names": proj3_patch_names,
        "proj16_contrast": proj16_contrast,
        "a22_counts": a22_counts,
        "j2_alignment": j2_alignment,
        "proj5_gather": proj5_gather,
        "proj6_index_report": proj6_index_report,
        "proj7_valid_index": proj7_valid_index,
        "proj29_random_crops": proj29_random_crops,
        "s23_pixel_slice": s23_pixel_slice,
    }


def _grid(mosaics: str, size: int) -> str:
    by = size // 2
    return f"""g0 AS (SELECT mosaic_name, width, unnest(range(0, height - {size} + 1, {by})) AS pos_row FROM {mosaics} WHERE height >= {size} AND width >= {size}),
g AS (SELECT mosaic_name, pos_row, unnest(range(0, width - {size} + 1, {by})) AS pos_col FROM g0)"""


def _pairs_sql(offsets: list[tuple[int, int]]) -> str:
    values = ", ".join(f"({r}, {c})" for r, c in offsets)
    return f"""WITH {CUTOUTS}, o(r, k) AS (VALUES {values})
SELECT a.id, b.id AS neighbor_id FROM c a, o, c b
WHERE a.mosaic_name = b.mosaic_name AND a.pos_row + o.r = b.pos_row AND a.pos_col + o.k = b.pos_col AND a.id <> b.id"""


_UNORDERED = f"SELECT DISTINCT least(id, neighbor_id) AS id_a, greatest(id, neighbor_id) AS id_b FROM ({_pairs_sql(eight(128))})"
_PAIRS_IN = f"""{FEATURES}, k AS (SELECT v AS c, row_number() OVER (ORDER BY id) - 1 AS cluster_id FROM (SELECT * FROM u ORDER BY id LIMIT 8)),
ag AS (SELECT u.id, k.cluster_id FROM u, k QUALIFY row_number() OVER (PARTITION BY u.id ORDER BY list_distance(u.v, k.c), k.cluster_id) = 1),
pr AS ({_UNORDERED}),
j AS (SELECT x.cluster_id, count(*) AS pairs FROM pr JOIN ag x ON x.id = pr.id_a JOIN ag y ON y.id = pr.id_b WHERE x.cluster_id = y.cluster_id GROUP BY 1),
cp AS (SELECT a.cluster_id, coalesce(j.pairs, 0) AS pairs FROM (SELECT DISTINCT cluster_id FROM ag) a LEFT JOIN j USING (cluster_id))"""
_ENTRIES = "i AS (SELECT event_id AS position, CASE WHEN event_id % 7 = 0 THEN 'x' ELSE json_extract_string(props, '$.k') END AS entry FROM events)"
_ORIGIN = "SELECT arg_min(pos_row, id) AS r0, arg_min(pos_col, id) AS c0, arg_min(size, id) AS s0"
_ON_GRID = "((pos_row - r0) % s0 + s0) % s0 = 0 AND ((pos_col - c0) % s0 + s0) % s0 = 0"


def oracle_sql():
    return {
        "proj3_patch_names": f"""WITH {_grid("mosaics", SIZE)} SELECT mosaic_name, format('patch_{{}}_{{}}.npy', pos_row, pos_col) AS file_name FROM g""",
        "proj1_cutout_grid": f"""WITH {_grid("mosaics", SIZE)} SELECT mosaic_name, pos_row, pos_col, 'patch_' || pos_row || '_' || pos_col || '.npy' AS file_name FROM g""",
        "proj2_blank_filter": f"""WITH {PIXELS}, {_grid("m", 4)} SELECT mosaic_name, pos_row, pos_col FROM g WHERE NOT EXISTS (SELECT 1 FROM px
WHERE px.mosaic_name = g.mosaic_name AND px.value IS NULL AND px."row" BETWEEN g.pos_row AND g.pos_row + 3 AND px."col" BETWEEN g.pos_col AND g.pos_col + 3)""",
        "proj4_non_overlap": f"""WITH {CUTOUTS}, o AS ({_ORIGIN} FROM c WHERE pos_row IS NOT NULL AND pos_col IS NOT NULL AND size > 0)
SELECT id, mosaic_name, pos_row, pos_col FROM c, o WHERE {_ON_GRID}""",
        "proj4_non_overlap_by_mosaic": f"""WITH {CUTOUTS}, o AS ({_ORIGIN}, mosaic_name FROM c WHERE pos_row IS NOT NULL AND pos_col IS NOT NULL AND size > 0 GROUP BY mosaic_name)
SELECT c.id, c.mosaic_name, pos_row, pos_col FROM c JOIN o ON c.mosaic_name = o.mosaic_name WHERE {_ON_GRID}""",
        "w1_merge_reindex": f"""WITH {CUTOUTS}, t AS (SELECT *, CASE WHEN survey IS NULL THEN 1 ELSE 0 END AS source_ord FROM c)
SELECT row_number() OVER (ORDER BY source_ord, id) - 1 AS new_id, source_ord, id, file_path FROM t""",
        "j3_neighbors4": _pairs_sql(four(256, 128)),
        "j4_neighbors_diag": _pairs_sql(diagonal(256, 128)),
        "j5_neighbors8": _pairs_sql(eight(128)),
        "u3_unordered_pairs": _UNORDERED,
        "j13_cluster_pairs": f"WITH {_PAIRS_IN} SELECT * FROM cp",
        "a15_pair_statistics": f"WITH {_PAIRS_IN} SELECT round(avg(pairs), 6) AS mean_pairs, max(pairs) AS max_pairs, min(pairs) AS min_pairs FROM cp",
        "a1_blank_mean_std": f"WITH {PIXELS} SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM px",
        "proj16_contrast": f"""WITH {PIXELS}, q AS (SELECT mosaic_name, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM px WHERE value IS NOT NULL GROUP BY 1)
SELECT mosaic_name, round((lo + hi) / 2 - CASE WHEN hi > lo THEN (hi - lo) / 2 ELSE 0.1 END / sqrt(10), 6) AS low, round((lo + hi) / 2 + CASE WHEN hi > lo THEN (hi - lo) / 2 ELSE 0.1 END / sqrt(10), 6) AS high FROM q""",
        "a22_counts": f"WITH {CUTOUTS} SELECT cutout_run, count(*) AS num_cutouts FROM c GROUP BY 1",
        "j2_alignment": """WITH f AS (SELECT id, min(file_path) AS fp FROM features GROUP BY 1), m AS (SELECT id, min(file_path) AS mp FROM cutouts GROUP BY 1)
SELECT CASE WHEN f.id IS NULL THEN 'no feature' WHEN m.id IS NULL THEN 'no cutout' WHEN fp IS DISTINCT FROM mp THEN 'paths differ' ELSE 'aligned' END AS problem, count(*) AS n
FROM f FULL OUTER JOIN m ON f.id = m.id GROUP BY 1""",
        "proj5_gather": "SELECT md5(concat_ws('|', t, c_custkey)) AS position, c_custkey AS id, c_name FROM customer, (VALUES (0), (1)) v(t)",
        "proj6_index_report": f"""WITH {_ENTRIES}, t AS (SELECT TRY_CAST(entry AS BIGINT) BETWEEN 0 AND 49 AS good FROM i)
SELECT count(*) AS entries, count(*) FILTER (good) AS valid, count(*) FILTER (NOT coalesce(good, false)) AS dropped FROM t""",
        "proj7_valid_index": f"WITH {_ENTRIES} SELECT position, TRY_CAST(entry AS BIGINT) AS id FROM i WHERE TRY_CAST(entry AS BIGINT) BETWEEN 0 AND 49",
        "proj29_random_crops": """SELECT mosaic_name, CAST('0x' || substr(md5('crop|' || mosaic_name), 1, 8) AS BIGINT) % (height - 255) AS pos_row,
CAST('0x' || substr(md5('crop|' || mosaic_name), 9, 8) AS BIGINT) % (width - 255) AS pos_col FROM mosaics WHERE height >= 256 AND width >= 256""",
        "s23_pixel_slice": f"""WITH {PIXELS} SELECT mosaic_name, "row", "col", round(value, 6) AS value FROM px WHERE "row" BETWEEN 4 AND 9 AND "col" BETWEEN 3 AND 8""",
    }
