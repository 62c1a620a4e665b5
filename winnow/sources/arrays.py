"""Matrices and images in files (rows S2, S5-S9, S14-S16, S23, S26)."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from winnow.sources.errors import SourceNotFoundError

#: Rows of a matrix that one task reads.
ROWS = 100_000


class _Rows(InputPartition):
    def __init__(self, path: str, start: int, stop: int, first: int):
        super().__init__(None)
        self.path, self.start, self.stop, self.first = path, start, stop, first


class _NpyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.path, "*.npy"))) if os.path.isdir(self.path) else [self.path]
        out, first = [], 0
        for f in files:
            shape = np.load(f, mmap_mode="r", allow_pickle=False).shape
            if len(shape) != 2:
                raise ValueError(f"{f} is no matrix")
            out += [_Rows(f, a, min(a + ROWS, shape[0]), first + a) for a in range(0, shape[0], ROWS)]
            first += shape[0]
        return out or [_Rows("", 0, 0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        matrix = np.load(partition.path, mmap_mode="r", allow_pickle=False)
        for a in range(partition.start, partition.stop, 10_000):
            b = min(a + 10_000, partition.stop)
            x = np.asarray(matrix[a:b], np.float32)
            offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))
            ids = pa.array(np.arange(b - a) + partition.first + a - partition.start)
            yield pa.RecordBatch.from_arrays([ids, lists], names=["id", "embedding"])


class NpySource(DataSource):
    """``spark.read.format("npy").load(path)``: the rows of a matrix, or of all matrices of a folder, in the
    order of the file names, numbered from 0.  Each task maps its own range of rows."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "id long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options["path"].removeprefix("file:"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature table from .npy, .parquet or, with h5py, .h5; another suffix is a ValueError."""
    suffix = os.path.splitext(path.rstrip("/"))[1]
    if suffix == ".npy":
        if not os.path.exists(path.removeprefix("file:")):
            raise SourceNotFoundError(path)
        spark.dataSource.register(NpySource)
        return spark.read.format("npy").load(path)
    if suffix in (".h5", ".hdf5"):
        return _from_h5(spark, path)
    if suffix == ".parquet":
        try:
            return spark.read.parquet(path)
        except Exception as problem:
            raise SourceNotFoundError(path) from problem
    raise ValueError(f"unknown kind of feature file: {path}")


def _from_h5(spark: SparkSession, path: str) -> DataFrame:
    try:
        import h5py
    except ImportError as missing:
        raise SourceNotFoundError("reading .h5 needs h5py") from missing
    with h5py.File(path, "r") as f:
        rows = f["features"].shape[0]

    def run(batches):
        import h5py

        for batch in batches:
            for start in batch.column(0).to_pylist():
                with h5py.File(path, "r") as f:
                    x = np.asarray(f["features"][start : start + ROWS], np.float32)
                    paths = [p.decode() if isinstance(p, bytes) else p for p in f["image_paths"][start : start + ROWS]] if "image_paths" in f else [None] * len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(start, start + len(x))), pa.array(paths, pa.string()), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "file_path", "embedding"]
                )

    starts = spark.range(0, rows, ROWS)
    return starts.repartition(max(1, -(-rows // ROWS)), "id").mapInArrow(run, "id long, file_path string, embedding array<float>")


def write_features(features: DataFrame, folder: str, mode: str = "error") -> None:
    """The table as Parquet, the format that all conversions end in."""
    features.write.mode(mode).parquet(folder)


def npy_files(features: DataFrame, folder: str, rows: int = ROWS, vector: str = "embedding") -> DataFrame:
    """The vectors as .npy matrices of ``rows`` rows, in the order of their ids: (path, rows) of what was written.

    ``folder`` is one that all executors share.  The files are numbered in order, so :func:`read_features` of the
    folder gives them back with ids counted from 0.  Vectors of a file have one length; null ones are an error.
    """
    from winnow.functions.order import numbered

    placed = numbered(features.select("id", vector), "id", name="place")
    os.makedirs(folder, exist_ok=True)

    def write(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("place").to_numpy())
        part = int(table.column("part")[0].as_py())
        x = np.array([table.column(vector)[int(k)].as_py() for k in order], np.float32)
        if x.ndim != 2 or np.isnan(x).all():
            raise ValueError("vectors are null or of different lengths")
        path = os.path.join(folder, f"part-{part:08d}.npy")
        with open(f"{path}.writing", "wb") as f:
            np.save(f, x)
        os.replace(f"{path}.writing", path)  # a task that runs twice leaves one whole file
        return pa.table({"path": [path], "rows": [len(x)]})

    parts = placed.withColumn("part", F.floor(F.col("place") / rows))
    return parts.groupBy("part").applyInArrow(write, "path string, rows long")


def write_npy_sample(sample: DataFrame, path: str, most: int = 100_000_000, ids: str = "id") -> int:
    """The ids of a sample, ascending, repeats kept, as a vector of whole numbers in one .npy file.

    A sample of more than ``most`` rows is an error; it is written as Parquet (:func:`write_sample`)."""
    n = sample.count()
    if n > most:
        raise ValueError(f"{n} rows are too many for one file")
    values = sample.select(F.col(ids).cast("long").alias("i")).toArrow().column("i").to_numpy()
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "wb") as f:
        np.save(f, np.sort(values))
    return n


def write_sample(sample: DataFrame, root: str, name: str) -> str:
    """The sample as Parquet in a folder of the sample's name; returns the folder."""
    folder = f"{root.rstrip('/')}/{name}"
    sample.write.mode("overwrite").parquet(folder)
    return folder


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """(position, id) of a sample: an .npy vector of whole numbers, or a Parquet folder with an id.

    Anything else than a one-dimensional vector of whole numbers is a ValueError.
    """
    if not path.endswith(".npy"):
        try:
            table = spark.read.parquet(path)
        except Exception as problem:
            raise SourceNotFoundError(path) from problem
        if dict(table.dtypes).get("id") not in ("bigint", "int", "smallint", "tinyint"):
            raise ValueError(f"{path} has no whole numbers as id")
        from winnow.functions.order import numbered

        return numbered(table.select(F.col("id").cast("long")), "id", name="position").select("position", "id")
    local = path.removeprefix("file:")
    if not os.path.exists(local):
        raise SourceNotFoundError(path)
    vector = np.load(local, mmap_mode="r", allow_pickle=False)
    if vector.ndim != 1 or vector.dtype.kind not in "iu":
        raise ValueError(f"{path} is no vector of whole numbers, but {vector.dtype} of {vector.ndim} dimensions")
    size = len(vector)

    def run(batches):
        for batch in batches:
            for start in batch.column(0).to_pylist():
                part = np.load(local, mmap_mode="r", allow_pickle=False)[start : start + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(part))), pa.array(part.astype(np.int64))], names=["position", "id"])

    return spark.range(0, size, ROWS, max(1, min(size // ROWS + 1, 10_000))).mapInArrow(run, "position long, id long")


def write_neighbours(lists: DataFrame, folder: str, params: dict) -> None:
    """Lists (id, rank, neighbor_id, distance) as Parquet, and the parameters of the search beside them as JSON."""
    spark = lists.sparkSession
    lists.select("id", "rank", "neighbor_id", "distance").write.mode("overwrite").parquet(f"{folder.rstrip('/')}/lists")
    text = spark.createDataFrame([(json.dumps(params, sort_keys=True, default=str),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/params")


def read_neighbours(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """What :func:`write_neighbours` wrote."""
    try:
        lists = spark.read.parquet(f"{folder.rstrip('/')}/lists")
        params = json.loads(spark.read.text(f"{folder.rstrip('/')}/params").first()["value"])
    except Exception as problem:
        raise SourceNotFoundError(folder) from problem
    return lists, params


def _fits_card(card: bytes) -> tuple[str, str]:
    text = card.decode("ascii", "replace")
    value = text[10:].split("/")[0].strip() if text[8:10] == "= " else ""
    return text[:8].strip(), value


def parse_fits(data: bytes) -> np.ndarray:
    """The first image of a FITS file as doubles, blanks as NaN."""
    keys: dict[str, str] = {}
    at = 0
    while at + 80 <= len(data):
        name, value = _fits_card(data[at : at + 80])
        at += 80
        if name == "END":
            break
        keys.setdefault(name, value)
    else:
        raise ValueError("no end of the FITS header")
    if keys.get("SIMPLE") != "T" or int(keys.get("NAXIS", 0)) < 2:
        raise ValueError("no FITS image")
    start = -(-at // 2880) * 2880
    kind = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[int(keys["BITPIX"])]
    width, height = int(keys["NAXIS1"]), int(keys["NAXIS2"])
    raw = np.frombuffer(data, kind, width * height, start).reshape(height, width)
    image = raw.astype(np.float64)
    if "BLANK" in keys and raw.dtype.kind in "iu":
        image[raw == int(keys["BLANK"])] = np.nan
    return image * float(keys.get("BSCALE", 1)) + float(keys.get("BZERO", 0))


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, values) of the first image of each file, one row for each line of it."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = parse_fits(data)
                for a in range(0, len(image), 512):
                    part = image[a : a + 512]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(part)), pa.array(np.arange(a, a + len(part)).astype(np.int32)), pa.array(list(part), pa.list_(pa.float64()))],
                        names=["path", "row", "values"],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, row int, values array<double>")


def slices(pixels: DataFrame, row: int, col: int, size: int) -> DataFrame:
    """A window of a pixel table; the bounds reach the Parquet scan."""
    return pixels.where(F.col("row").between(row, row + size - 1) & F.col("col").between(col, col + size - 1))


def write_clustering(edges: DataFrame, centroids: DataFrame, folder: str) -> None:
    """A hierarchy as two tables partitioned by level."""
    edges.write.mode("overwrite").partitionBy("level").parquet(f"{folder}/edges")
    centroids.write.mode("overwrite").partitionBy("level").parquet(f"{folder}/centroids")


def read_clustering(spark: SparkSession, folder: str, levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, centroids) of a hierarchy, of the lowest ``levels`` if given."""
    try:
        both = spark.read.parquet(f"{folder}/edges"), spark.read.parquet(f"{folder}/centroids")
    except Exception as problem:
        raise SourceNotFoundError(folder) from problem
    return both if levels is None else tuple(t.where(F.col("level") <= levels) for t in both)


def read_level_folders(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(edges, centroids) of a hierarchy in folders level1, level2, ... of NumPy files.

    Each has ``centroids.npy``, a matrix, and ``sorted_clusters.npy``, an array of lists: of each cluster the rows of
    the level below (of the points at level 1), the nearest first.  Lists of Python objects are only
    read here, from files that the caller trusts.  A level is read by its own task, a cluster at a time.
    """
    local = folder.removeprefix("file:").rstrip("/")
    levels = sorted(int(n[5:]) for n in os.listdir(local) if n.startswith("level") and n[5:].isdigit()) if os.path.isdir(local) else []
    if not levels or levels != list(range(1, len(levels) + 1)):
        raise SourceNotFoundError(f"{folder} has no folders level1, level2, ...")

    def lists(batches):
        for batch in batches:
            for level in batch.column(0).to_pylist():
                found = np.load(f"{local}/level{level}/sorted_clusters.npy", allow_pickle=True)
                for parent, members in enumerate(found):
                    ids = np.asarray(members, np.int64)
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, level, np.int32)), pa.array(np.full(n, parent, np.int64)), pa.array(ids), pa.array(np.arange(1, n + 1, dtype=np.int32))],
                        names=["level", "parent_id", "child_id", "rank_in_cluster"],
                    )

    def matrices(batches):
        for batch in batches:
            for level in batch.column(0).to_pylist():
                x = np.load(f"{local}/level{level}/centroids.npy", mmap_mode="r", allow_pickle=False)
                for a in range(0, len(x), 10_000):
                    part = np.asarray(x[a : a + 10_000], np.float64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), level, np.int32)), pa.array(np.arange(a, a + len(part))), pa.array(list(part), pa.list_(pa.float64()))],
                        names=["level", "cluster_id", "centroid"],
                    )

    numbers = spark.range(1, len(levels) + 1, 1, len(levels))
    edges = numbers.mapInArrow(lists, "level int, parent_id long, child_id long, rank_in_cluster int")
    return edges, numbers.mapInArrow(matrices, "level int, cluster_id long, centroid array<double>")


def load_of_run(spark: SparkSession, runs: DataFrame, run_id: str, root: str, kind: str) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The table that a run's parameters name: ``kind`` is cutouts, features or clusters.

    The file name is looked up in the run's parameters, the merged manifest before that of one source, and is
    taken below ``root``/run_id.  A run that isn't there, or one without the parameter, is a
    SourceNotFoundError.
    """
    from winnow.sources.manifests import read_manifest

    keys = {"cutouts": ("merged_cutouts_info_filename", "cutouts_info_filename"), "features": ("features_filename",), "clusters": ("clusters_folder",)}
    if kind not in keys:
        raise ValueError(f"unknown kind {kind!r}")
    found = runs.where(F.col("run_id") == run_id).select("params").limit(1).collect()
    if not found:
        raise SourceNotFoundError(f"no run {run_id}")
    name = next((v for k in keys[kind] if (v := (found[0]["params"] or {}).get(k))), None)
    if name is None:
        raise SourceNotFoundError(f"run {run_id} names no {kind}")
    path = f"{root.rstrip('/')}/{run_id}/{name}"
    if kind == "cutouts":
        return read_manifest(spark, path)
    return read_features(spark, path) if kind == "features" else read_clustering(spark, path)
