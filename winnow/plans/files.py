"""Queries on files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from winnow.functions.files import remove
from winnow.functions.lineage import checkpoint_folder, cut
from winnow.operators.small_files import consolidate, idle


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.parquet(f"{folder}/patch_files.parquet")
    store = f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}"
    classified = consolidate(files, store)
    found = cut(idle(classified, spark.read.parquet(store)).select("file_id"))
    remove(spark, store)  # the store is what the operator is for, the query only asks what it does without
    return found


def queries():
    return {"p5_found": p5_found}


def oracle_sql():
    return {}
