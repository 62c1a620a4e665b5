"""Far too many small files: consolidation into few sorted ones (problem 5)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.functions.files import recovered, remove, swap
from winnow.functions.lineage import cut
from winnow.functions.npy import canonical, patch_name, read_npy
from winnow.functions.partitions import small

KEYS = ["run", "mosaic", "pos_row", "pos_col"]


def classify(files: DataFrame) -> DataFrame:
    """(file_id, run, mosaic, pos_row, pos_col, digest, bytes, complete) of every file.

    ``files`` has file_id, file_path and payload.  digest is of the shape and values of the array, and
    null where the payload holds no complete array.  A path that names no patch gives a null run and its
    own text as mosaic, so such arrays are versions of nothing but themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, digests, sizes = [], [], []
            for path, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                array = read_npy(payload)
                digests.append(None if array is None else _digest(array))
                names.append(patch_name(path) or (None, path, None, None))
                sizes.append(len(payload or b""))
            parts = list(zip(*names, strict=True)) if names else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(parts[0], pa.string()),
                    pa.array(parts[1], pa.string()),
                    pa.array(parts[2], pa.int64()),
                    pa.array(parts[3], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array([d is not None for d in digests], pa.bool_()),
                ],
                names=["file_id", *KEYS, "digest", "bytes", "complete"],
            )

    schema = "file_id long, run string, mosaic string, pos_row long, pos_col long, digest binary, bytes long, complete boolean"
    return files.select("file_id", "file_path", "payload").mapInArrow(run, schema)


def contributing(classified: DataFrame) -> DataFrame:
    """The first file of every patch version: (file_id, keys, digest, bytes, copies)."""
    first = F.min(F.struct("file_id", "bytes")).alias("first")
    versions = classified.where("complete and file_id is not null").groupBy(*KEYS, "digest").agg(first, F.count("*").alias("copies"))
    return versions.select("first.file_id", *KEYS, "digest", "first.bytes", "copies")


def consolidate(files: DataFrame, folder: str, target_bytes: int = 256 << 20) -> DataFrame:
    """Write every patch version once into few files of about ``target_bytes``; return the classified files.

    The records are range partitioned by run, mosaic, row, column and version, with boundaries that Spark
    samples from the data and as many partitions as the bytes need, and sorted within.  That is the only
    shuffle of payloads: what repeats a version stands beside its first file then and is dropped there; of a
    version with very many files only the first is sent.  A patch with very many versions spans partitions.
    The files go to a folder beside the final one.
    Number, ids and bytes of what was written are held against what was to be written, and only if they
    agree the folders are swapped.  An existing store is replaced, never left half written.

    The store has file_id, run, mosaic, pos_row, pos_col, file_path, modified_at, digest and payload.

    Defined cases: a null, empty, foreign or truncated payload contributes nothing; bytes beyond an
    array's end are kept and make no other version; of equal versions of a patch the smallest file_id
    stays; a null file_id is no file; a null path or one that names no patch is kept under its own text;
    an empty table gives an empty store; other columns are ignored.
    """
    spark = files.sparkSession
    classified = cut(classify(files))
    keep = cut(contributing(classified))
    planned = _totals(keep.select("file_id", "bytes"))
    parts = max(1, -(-planned[2] // target_bytes))
    extra = [c for c in ("file_path", "modified_at") if c in files.columns]
    often = max(1_000, -(-planned[0] // 100_000))  # at most 100,000 versions have more files than this on average
    many = keep.where(F.col("copies") > often).select("digest", *KEYS, F.col("file_id").alias("first"))
    known = _with_payload(files, extra)
    if not many.isEmpty():
        same = [known["digest"] == many["digest"], *(known[k].eqNullSafe(many[k]) for k in KEYS)]
        hot = small(many)
        known = known.join(hot, same, "left").where(F.col("first").isNull() | (F.col("first") == F.col("file_id"))).select(*(known[c] for c in known.columns))
    order = [*KEYS, "digest"]
    staging = f"{folder.rstrip('/')}.staging"
    recovered(spark, folder)
    remove(spark, staging)
    placed = known.repartitionByRange(int(parts), *order).sortWithinPartitions(*order, "file_id")
    placed.mapInArrow(_first_of_version, placed.schema).write.parquet(staging)
    written = _totals(spark.read.parquet(staging).select("file_id", F.length("payload").cast("long").alias("bytes")))
    if written != planned:
        raise RuntimeError(f"{staging} holds {written} instead of {planned} (files, sum of ids, bytes)")
    swap(spark, staging, folder)
    return classified


def _with_payload(files: DataFrame, extra: list[str]) -> DataFrame:
    """The complete files with what names their version: (file_id, keys, extra, digest, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, names, digests = [], [], []
            for row, (file_id, path, payload) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file_id", "file_path", "payload")), strict=True)):
                array = read_npy(payload) if file_id is not None else None
                if array is not None:
                    keep.append(row)
                    names.append(patch_name(path) or (None, path, None, None))
                    digests.append(_digest(array))
            few = batch.take(pa.array(keep, pa.int64()))
            parts = list(zip(*names, strict=True)) if names else [()] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [few.column("file_id"), *(pa.array(p, k) for p, k in zip(parts, kinds, strict=True)), *(few.column(c) for c in extra), pa.array(digests, pa.binary()), few.column("payload")],
                names=["file_id", *KEYS, *extra, "digest", "payload"],
            )

    rows = files.select("file_id", *dict.fromkeys(["file_path", *extra]), "payload")
    kinds = "".join(f"`{c}` {files.schema[c].dataType.simpleString()}, " for c in extra)
    return rows.mapInArrow(run, f"file_id long, run string, mosaic string, pos_row long, pos_col long, {kinds}digest binary, payload binary")


def _first_of_version(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows the first of each version."""
    before = None
    for batch in batches:
        keep = []
        for row, version in enumerate(zip(*(batch.column(c).to_pylist() for c in (*KEYS, "digest")), strict=True)):
            if version != before:
                keep.append(row)
            before = version
        yield batch.take(pa.array(keep, pa.int64()))


def _digest(array) -> bytes:
    return hashlib.blake2b(canonical(array), digest_size=16).digest()


def _totals(rows: DataFrame) -> tuple[int, int, int]:
    n, ids, size = rows.agg(F.count("*"), F.sum(F.xxhash64("file_id").cast("decimal(38,0)")), F.sum("bytes")).first()
    return n, int(ids or 0), int(size or 0)


def idle(classified: DataFrame, store: DataFrame) -> DataFrame:
    """The files that the store does without: (file_id, reason)."""
    missing = classified.where("file_id is not null").join(store.select("file_id"), "file_id", "left_anti")
    reason = F.when(F.col("complete"), "repeats a version").otherwise("no complete array")
    return missing.select("file_id", reason.alias("reason"))
