"""Annotations (rows P13, P22, P24, J1, J7, A19, A24, U7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def categories(literal: Column) -> Column:
    """The strings of a list literal; an empty list for anything else."""
    text = F.trim(literal)
    listed = text.rlike(r"^\[\s*\]$") | text.rlike(r"""^\[\s*('[^'"\\]*'|"[^'"\\]*")(\s*,\s*('[^'"\\]*'|"[^'"\\]*"))*\s*,?\s*\]$""")
    entries = F.transform(F.regexp_extract_all(text, F.lit(r"""'([^']*)'|"([^"]*)\""""), F.lit(0)), lambda x: F.substring(x, 2, 1 << 20))
    entries = F.transform(entries, lambda x: F.left(x, F.length(x) - 1))
    return F.when(F.coalesce(listed, F.lit(False)), entries).otherwise(F.array().cast("array<string>"))


def parsed(annotations: DataFrame) -> DataFrame:
    """(file_path, annotated_at, categories), paths without blanks around."""
    return annotations.select(F.trim("file_path").alias("file_path"), "annotated_at", categories(F.col("categories")).alias("categories"))


def labelled(annotations: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, file_path, categories) of annotations whose path is in the manifest; labels are the small side."""
    m = manifest.select("id", "file_path").dropDuplicates(["id"])
    return m.join(parsed(annotations), "file_path").select("id", "file_path", "categories")


def unlabelled(annotations: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries without an annotation."""
    return manifest.select("id", "file_path").dropDuplicates(["id"]).join(parsed(annotations), "file_path", "left_anti")


def counts(annotations: DataFrame) -> DataFrame:
    """(category, n), without case."""
    return parsed(annotations).select(F.explode("categories").alias("c")).groupBy(F.lower(F.trim("c")).alias("category")).agg(F.count("*").alias("n"))


def combinations(annotations: DataFrame) -> DataFrame:
    """(file_path, combo, wedge): sorted labels of a row and the share of a circle for each."""
    p = parsed(annotations)
    combo = F.array_sort(F.coalesce("categories", F.array().cast("array<string>")))
    n = F.size("categories")
    return p.select("file_path", F.array_join(combo, ",").alias("combo"), F.when(n > 0, F.lit(360.0) / n).alias("wedge"))


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Annotations with those of ``new`` in the place of older ones of the same path, else added."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    w = W.partitionBy("file_path").orderBy(F.desc("_turn"), F.desc_nulls_last("annotated_at"), F.desc_nulls_last("annotator"), F.desc_nulls_last("categories"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_turn")


def safe_name(name: Column) -> Column:
    """Letters, digits, blanks and underscores of a category."""
    return F.regexp_replace(name, r"[^A-Za-z0-9 _]", "")
