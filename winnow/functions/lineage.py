"""Cutting the lineage of iterative jobs in a way that survives the loss of executors."""

from __future__ import annotations

import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only where a local session has none."""
    context = spark.sparkContext
    now = context.getCheckpointDir()
    if now:
        return now
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="winnow-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint.

    A checkpoint keeps the estimated size of what it was made from, and that of a join is a product: in
    a loop of joins the estimate grows without bound.  So the rows are taken up as a new source of unknown size.
    """
    checkpoint_folder(df.sparkSession)
    kept = df.checkpoint(eager=True)
    try:
        rows = kept._jdf.queryExecution().toRdd()
        fresh = df.sparkSession._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False)
    except (AttributeError, Py4JError):
        return kept
    return DataFrame(fresh, df.sparkSession)
