"""Folders on any file system that Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    fs, path = _at(spark, folder)
    return fs.exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    fs, path = _at(spark, folder)
    fs.delete(path, True)


def swap(spark: SparkSession, new: str, final: str) -> None:
    """Put folder ``new`` in the place of ``final``; what was there is moved aside and removed at the end.

    Between the two renames there is no ``final``; :func:`recovered` puts the old one back if a driver died there.
    """
    recovered(spark, final)
    fs, source = _at(spark, new)
    _, target = _at(spark, final)
    old = spark._jvm.org.apache.hadoop.fs.Path(_aside(final))
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"{final} can't be moved aside")
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"{new} can't be moved to {final}")
    if had:
        fs.delete(old, True)


def _aside(final: str) -> str:
    return f"{final.rstrip('/')}.replaced"


def recovered(spark: SparkSession, final: str) -> bool:
    """Mend what a swap left that was broken off: without ``final`` what was moved aside comes back, else it
    is removed.  Whether there is a ``final`` now."""
    fs, target = _at(spark, final)
    _, old = _at(spark, _aside(final))
    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)
        elif not fs.rename(old, target):
            raise OSError(f"{_aside(final)} can't be moved back")
    return fs.exists(target)


def listing(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, bytes) of the data files of a written table."""
    fs, path = _at(spark, folder)
    return [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(path) if not s.getPath().getName().startswith(("_", "."))]


def folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in a folder."""
    fs, path = _at(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
