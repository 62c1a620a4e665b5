"""Cutout manifests, mosaic folders and annotations (rows S1, S3, S4, S12, S13, S22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.sources.errors import SourceNotFoundError

#: The two files that make a mosaic folder complete.
IMAGE, MASK = "mosaic-blanked.fits", "mosaic.pybdsmmask.fits"
ENTRY = "struct<file_path:string,survey:string,mosaic_name:string,position:array<int>,size:int,source_type:string>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(id, file_path, survey, mosaic_name, position, size, source_type) of JSON objects keyed by id.

    A folder or pattern gives the entries of all its files.  Keys that are no whole numbers, and files that
    are no JSON objects, raise :class:`SourceNotFoundError`; an empty object has no entries.
    """
    try:
        text = spark.read.text(path, wholetext=True)
        parsed = text.select(F.from_json("value", f"map<string,{ENTRY}>").alias("m"), "value")
        if parsed.where("m is null").limit(1).count():
            raise SourceNotFoundError(f"{path} holds something else than a JSON object")
    except SourceNotFoundError:
        raise
    except Exception as problem:
        raise SourceNotFoundError(f"{path} can't be read") from problem
    rows = parsed.select(F.explode("m").alias("key", "entry"))
    return rows.select(F.col("key").cast("long").alias("id"), "entry.*")


def read_manifests(spark: SparkSession, paths: list[str]) -> tuple[list[DataFrame], list[str]]:
    """U1's input: the manifests that can be read, in order, and a message for each that can't."""
    found, messages = [], []
    for p in paths:
        try:
            found.append(read_manifest(spark, p))
        except SourceNotFoundError as problem:
            messages.append(str(problem))
    return found, messages


def write_manifest(entries: DataFrame, folder: str) -> None:
    """The entries as JSON lines, one file for each partition."""
    entries.write.mode("overwrite").json(folder)


def mosaic_folders(spark: SparkSession, path: str) -> DataFrame:
    """(mosaic_name, mosaic_path, mask_path) of the folders below ``path``/mosaics that hold both files.

    Only names are listed, in order of the mosaics; contents aren't read.
    """
    try:
        files = spark.read.format("binaryFile").load(f"{path}/mosaics/*/*").select("path")
    except Exception as problem:
        raise SourceNotFoundError(f"{path}/mosaics is no folder of mosaics") from problem
    named = files.select("path", F.element_at(F.split("path", "/"), -2).alias("mosaic_name"), F.substring_index("path", "/", -1).alias("name"))
    both = named.groupBy("mosaic_name").agg(
        F.max(F.when(F.col("name") == IMAGE, F.col("path"))).alias("mosaic_path"), F.max(F.when(F.col("name") == MASK, F.col("path"))).alias("mask_path")
    )
    return both.where("mosaic_path is not null and mask_path is not null")


def folders_without(spark: SparkSession, path: str, name: str = "info.json") -> DataFrame:
    """The folders below ``path`` that have files, but none of this name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    parts = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.substring_index("path", "/", -1).alias("name"))
    return parts.groupBy("folder").agg(F.max((F.col("name") == name).cast("int")).alias("has")).where("has = 0").select("folder")


def misnamed(spark: SparkSession, path: str, name: str = "info") -> DataFrame:
    """(path, new_path) of files ``info`` to ``.json`` with further characters before the suffix, and the name they
    ought to have; a folder with several of them, or with the right one, is left alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    parts = files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.substring_index("path", "/", -1).alias("file"))
    wrong = F.col("file").rlike(rf"^{name}.+[.]json$")
    right = F.col("file") == f"{name}.json"
    sums = parts.groupBy("folder").agg(F.count_if(wrong).alias("n"), F.count_if(right).alias("ok"), F.max(F.when(wrong, F.col("path"))).alias("path"))
    return sums.where("n = 1 and ok = 0").select("path", F.concat("folder", F.lit(f"/{name}.json")).alias("new_path"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, categories) of CSV files with a header."""
    try:
        return spark.read.csv(path, header=True, schema="file_path string, categories string", enforceSchema=True)
    except Exception as problem:
        raise SourceNotFoundError(f"{path} can't be read") from problem
