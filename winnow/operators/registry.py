"""Run records and their lineage (rows R1-R5, J14, A20, L5, S11)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.lineage import cut


class AmbiguousRun(ValueError):
    """No run or several runs fit."""


def config_hash(config: dict, exclude: tuple[str, ...] = ()) -> str:
    """P20: the first 8 hex digits of the md5 of the sorted JSON."""
    kept = {k: v for k, v in config.items() if k not in exclude}
    return hashlib.md5(json.dumps(kept, sort_keys=True).encode()).hexdigest()[:8]


def record(runs: DataFrame, run_id: str, experiment: str, params: dict, tags: dict | None = None) -> DataFrame:
    """The runs with one more; every value becomes a string."""
    spark = runs.sparkSession
    texts = {str(k): str(v) for k, v in params.items()}
    row = spark.createDataFrame([(run_id, experiment, texts, tags or {})], "run_id string, experiment string, params map<string,string>, tags map<string,string>")
    return runs.unionByName(row.withColumn("start_time", F.current_timestamp().cast("timestamp_ntz")), allowMissingColumns=True)


def matching(runs: DataFrame, experiment: str | None = None, params: dict | None = None, tags: dict | None = None) -> DataFrame:
    """R2: runs that fit all given values, the most recent first."""
    if not (experiment or params or tags):
        raise ValueError("at least one condition is needed")
    out = runs if experiment is None else runs.where(F.col("experiment") == experiment)
    for column, wanted in (("params", params), ("tags", tags)):
        for k, v in (wanted or {}).items():
            out = out.where(F.try_element_at(F.col(column), F.lit(k)) == str(v))
    return out.orderBy(F.desc("start_time"), "run_id")


def unique_run(runs: DataFrame, **conditions) -> str:
    """R2: the id of the one run that fits; an error that says so if none or several do."""
    found = matching(runs, **conditions).select("run_id").limit(2).collect()
    if len(found) != 1:
        raise AmbiguousRun("no run fits" if not found else "several runs fit")
    return found[0]["run_id"]


def differing(runs: DataFrame) -> DataFrame:
    """(key, n_values) of parameters with more than one value, a missing one not counted."""
    return runs.select(F.explode("params").alias("key", "value")).groupBy("key").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def differing_values(runs: DataFrame) -> DataFrame:
    """(run_id, key, value) of the parameters that differ."""
    return runs.select("run_id", F.explode("params").alias("key", "value")).join(F.broadcast(differing(runs).select("key")), "key").select("run_id", "key", "value")


def copied(runs: DataFrame, run_id: str, new_id: str) -> DataFrame:
    """A run under a new id, without system tags, with the id it was copied from."""
    tags = F.map_concat(
        F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, v: ~k.startswith("mlflow.") & (k != "copied_from_run_id")),
        F.create_map(F.lit("copied_from_run_id"), F.col("run_id")),
    )
    return runs.where(F.col("run_id") == run_id).withColumn("tags", tags).withColumn("run_id", F.lit(new_id))


def copied_rows(rows: DataFrame, run_id: str, new_id: str) -> DataFrame:
    """A run's rows of a table keyed by run_id, such as the history of its metrics or the list of its artifacts,
    under a new id."""
    return rows.where(F.col("run_id") == run_id).withColumn("run_id", F.lit(new_id))


def parent(params: str = "params", tags: str = "tags") -> Column:
    """The run that a run was made from: by tag, else by parameter."""
    keys = [F.try_element_at(F.col(tags), F.lit("parent_run")), F.try_element_at(F.col(tags), F.lit("mlflow.parentRunId"))]
    keys += [F.try_element_at(F.col(params), F.lit(k)) for k in ("clusters_id", "features_run_id", "parent_run")]
    return F.coalesce(*keys)


def lineage(runs: DataFrame) -> DataFrame:
    """(run_id, step, ancestor_id, experiment): the runs a run goes back to, as far as they are known.

    A chain that comes back to a run ends before that run is named again.
    """
    links = runs.select("run_id", parent().alias("parent_id"), "experiment")
    own = links.select(F.col("run_id").alias("ancestor_id"), F.col("parent_id").alias("next"), "experiment")
    front = links.select("run_id", F.col("parent_id").alias("ancestor_id"), F.array("run_id").alias("seen"))
    out, k = None, 0
    while out is None or not front.isEmpty():
        k += 1
        hit = cut(front.where("ancestor_id is not null and not array_contains(seen, ancestor_id)").join(own, "ancestor_id"))
        rows = hit.select("run_id", F.lit(k).alias("step"), "ancestor_id", "experiment")
        out = rows if out is None else out.unionAll(rows)
        front = hit.select("run_id", F.col("next").alias("ancestor_id"), F.concat("seen", F.array("ancestor_id")).alias("seen"))
    return out


def manifest_file(params: str = "params") -> Column:
    """The manifest of a run, the merged one if there is one."""
    return F.coalesce(*(F.try_element_at(F.col(params), F.lit(k)) for k in ("merged_cutouts_info_filename", "cutouts_info_filename")))
