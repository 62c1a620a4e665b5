"""Queries on run records, annotations and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions import names as N
from winnow.operators import labels as L
from winnow.operators import registry as R
from winnow.plans.common import CUTOUTS, cutouts, table


def _runs(spark, folder):
    return table(spark, folder, "runs")


def r2_find_run(spark, folder):
    return R.matching(_runs(spark, folder), params={"overlap": ".5"}).select("run_id", "experiment", "start_time")


def r3_differing_params(spark, folder):
    return R.differing(_runs(spark, folder))


def r3_differing_values(spark, folder):
    return R.differing_values(_runs(spark, folder))


def r4_copy_run(spark, folder):
    runs = _runs(spark, folder)
    first = runs.orderBy("run_id").limit(1).collect()[0]["run_id"]
    c = R.copied(runs, first, "copy")
    return c.select("run_id", "experiment", F.explode("tags").alias("key", "value"))


def j14_lineage(spark, folder):
    return R.lineage(_runs(spark, folder))


def s11_manifest_files(spark, folder):
    return _runs(spark, folder).select("run_id", R.manifest_file().alias("manifest"))


def l6_head(spark, folder):
    """The first rows of the sorted runs, as a report."""
    return _runs(spark, folder).orderBy("run_id").select("run_id", "experiment").limit(3)


def l5_recent_first(spark, folder):
    return R.matching(_runs(spark, folder), experiment="features").select("run_id", "start_time")


def _annotations(spark, folder):
    return table(spark, folder, "annotations")


def proj13_parse_labels(spark, folder):
    return L.parsed(_annotations(spark, folder)).select("file_path", "annotated_at", F.array_join("categories", "|").alias("categories"))


def j1_labelled(spark, folder):
    return L.labelled(_annotations(spark, folder), cutouts(spark, folder)).select("id", "file_path", F.array_join("categories", "|").alias("categories"))


def j7_unlabelled(spark, folder):
    return L.unlabelled(_annotations(spark, folder), cutouts(spark, folder)).select("id")


def a19_label_counts(spark, folder):
    return L.counts(_annotations(spark, folder))


def a24_combinations(spark, folder):
    return L.combinations(_annotations(spark, folder)).withColumn("wedge", F.round("wedge", 6))


def u7_upsert(spark, folder):
    a = _annotations(spark, folder).select("file_path", "categories", "annotator", "annotated_at")
    late = F.coalesce(F.col("annotated_at") >= F.lit("2024-12-01").cast("timestamp_ntz"), F.lit(False))
    return L.upserted(a.where(~late), a.where(late))


def proj22_safe_names(spark, folder):
    return L.counts(_annotations(spark, folder)).select("category", L.safe_name(F.col("category")).alias("safe"))


def proj18_sanitize(spark, folder):
    return cutouts(spark, folder).select("id", N.sanitised(F.col("file_path")).alias("safe"), N.basename(F.col("file_path")).alias("base"), N.short_hash(F.col("file_path")).alias("hash"))


def proj19_readable_names(spark, folder):
    name = N.readable("run", ["size", "overlap"], F.col("params"), N.short_hash(F.col("run_id")))
    return _runs(spark, folder).select("run_id", name.alias("name"))


def proj21_parameters(spark, folder):
    entries = F.concat(F.transform(F.map_entries("params"), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("")))), F.array(F.lit("nothing"), F.lit("a=1"), F.lit("a=b=c")))
    return _runs(spark, folder).select("run_id", F.explode(N.parameters(entries)).alias("key", "value"))


def proj31_hosts(spark, folder):
    s = table(spark, folder, "supplier")
    spec = F.concat(F.lit("node["), F.lpad((F.col("s_suppkey") % 7).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("s_suppkey") % 7 + 2).cast("string"), 2, "0"), F.lit(",9]"))
    return s.select("s_suppkey", F.explode(N.hosts(F.when(F.col("s_suppkey") % 5 == 0, F.lit("login")).otherwise(spec))).alias("host"))


def queries():
    names = [r2_find_run, r3_differing_params, r3_differing_values, r4_copy_run, j14_lineage, s11_manifest_files, l5_recent_first, l6_head, proj13_parse_labels, j1_labelled, j7_unlabelled, a19_label_counts, a24_combinations, u7_upsert, proj22_safe_names, proj18_sanitize, proj19_readable_names, proj21_parameters, proj31_hosts]
    return {f.__name__: f for f in names}


_PARENT = "coalesce(tags['parent_run'], tags['mlflow.parentRunId'], params['clusters_id'], params['features_run_id'], params['parent_run'])"
_LIST = r"""^\[\s*\]$|^\[\s*('[^'"\\]*'|"[^'"\\]*")(\s*,\s*('[^'"\\]*'|"[^'"\\]*"))*\s*,?\s*\]$"""
_PARSED = f"""pa AS (SELECT trim(file_path) AS file_path, annotated_at, CASE WHEN regexp_matches(trim(categories), $list${_LIST}$list$)
  THEN list_transform(regexp_extract_all(trim(categories), $$'[^']*'|"[^"]*"$$), lambda x: x[2:len(x) - 1]) ELSE []::VARCHAR[] END AS cats FROM annotations)"""


def oracle_sql():
    return {
        "r2_find_run": "SELECT run_id, experiment, start_time FROM runs WHERE params['overlap'] = '.5'",
        "r3_differing_params": "SELECT key, count(DISTINCT value) AS n_values FROM (SELECT unnest(map_entries(params), recursive := true) FROM runs) GROUP BY key HAVING count(DISTINCT value) > 1",
        "r3_differing_values": """WITH e AS (SELECT run_id, unnest(map_entries(params), recursive := true) FROM runs)
SELECT * FROM e WHERE key IN (SELECT key FROM e GROUP BY key HAVING count(DISTINCT value) > 1)""",
        "r4_copy_run": """WITH o AS (SELECT * FROM runs ORDER BY run_id LIMIT 1), e AS (SELECT experiment, unnest(map_entries(tags), recursive := true) FROM o)
SELECT 'copy' AS run_id, experiment, key, value FROM e WHERE key NOT LIKE 'mlflow.%' AND key <> 'copied_from_run_id' UNION ALL SELECT 'copy', experiment, 'copied_from_run_id', run_id FROM o""",
        "j14_lineage": f"""WITH RECURSIVE l AS (SELECT run_id, {_PARENT} AS parent_id, experiment FROM runs),
t AS (SELECT l.run_id, 1 AS step, a.run_id AS ancestor_id, a.experiment, a.parent_id AS nxt FROM l JOIN l a ON a.run_id = l.parent_id
UNION ALL SELECT t.run_id, t.step + 1, a.run_id, a.experiment, a.parent_id FROM t JOIN l a ON a.run_id = t.nxt WHERE t.step < 6)
SELECT run_id, step, ancestor_id, experiment FROM t""",
        "s11_manifest_files": "SELECT run_id, coalesce(params['merged_cutouts_info_filename'], params['cutouts_info_filename']) AS manifest FROM runs",
        "l6_head": "SELECT run_id, experiment FROM runs ORDER BY run_id LIMIT 3",
        "l5_recent_first": "SELECT run_id, start_time FROM runs WHERE experiment = 'features' ORDER BY start_time DESC, run_id",
        "proj13_parse_labels": f"WITH {_PARSED} SELECT file_path, annotated_at, array_to_string(cats, '|') AS categories FROM pa",
        "j1_labelled": f"WITH {CUTOUTS}, {_PARSED} SELECT c.id, file_path, array_to_string(cats, '|') AS categories FROM c JOIN pa USING (file_path)",
        "j7_unlabelled": f"WITH {CUTOUTS}, {_PARSED} SELECT id FROM c WHERE file_path NOT IN (SELECT file_path FROM pa WHERE file_path IS NOT NULL)",
        "a19_label_counts": f"WITH {_PARSED} SELECT lower(trim(c)) AS category, count(*) AS n FROM (SELECT unnest(cats) AS c FROM pa) GROUP BY 1",
        "a24_combinations": f"WITH {_PARSED} SELECT file_path, array_to_string(list_sort(cats), ',') AS combo, CASE WHEN len(cats) > 0 THEN round(360.0::DOUBLE / len(cats), 6) END AS wedge FROM pa",
        "u7_upsert": """SELECT file_path, categories, annotator, annotated_at FROM annotations QUALIFY row_number() OVER (PARTITION BY file_path
ORDER BY CASE WHEN annotated_at >= TIMESTAMP '2024-12-01' THEN 1 ELSE 0 END DESC, annotated_at DESC NULLS LAST, annotator DESC NULLS LAST, categories DESC NULLS LAST) = 1""",
        "proj22_safe_names": f"WITH {_PARSED} SELECT DISTINCT lower(trim(c)) AS category, regexp_replace(lower(trim(c)), '[^A-Za-z0-9 _]', '', 'g') AS safe FROM (SELECT unnest(cats) AS c FROM pa)",
        "proj18_sanitize": f"""WITH {CUTOUTS} SELECT id, left(regexp_replace(file_path, '[<>:"/\\\\|?*\\x00-\\x1F.]', '', 'g'), 255) AS safe,
split_part(file_path, '/', -1) AS base, substr(md5(file_path), 1, 8) AS hash FROM c""",
        "proj19_readable_names": r"""SELECT run_id, 'run-size_' || left(regexp_replace(coalesce(params['size'], ''), '[<>:"/\\|?*\x00-\x1F.]', '', 'g'), 255)
|| '-overlap_' || left(regexp_replace(coalesce(params['overlap'], ''), '[<>:"/\\|?*\x00-\x1F.]', '', 'g'), 255) || '_' || substr(md5(run_id), 1, 8) AS name FROM runs""",
        "proj21_parameters": """SELECT run_id, key, coalesce(value, '') AS value FROM (SELECT run_id, unnest(map_entries(params), recursive := true) FROM runs)
UNION ALL SELECT run_id, 'a', 'b=c' FROM runs""",
        "proj31_hosts": """SELECT s_suppkey, 'login' AS host FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT s_suppkey, 'node' || lpad(CAST(s_suppkey % 7 + i AS VARCHAR), 2, '0') FROM supplier, range(3) r(i) WHERE s_suppkey % 5 <> 0
UNION ALL SELECT s_suppkey, 'node9' FROM supplier WHERE s_suppkey % 5 <> 0""",
    }
