"""Spreading work over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """The rows in at least as many partitions as the session has cores.

    A table of one small file is one partition, and costly work on it one task.  Tables with enough
    partitions stay as they are, so large ones are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """The table marked for broadcast if it has at most ``rows`` rows, as it is otherwise: then Spark joins by
    a shuffle.  The rows are counted, up to the bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
