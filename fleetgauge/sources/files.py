"""Folders and files of the store, through the file system Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def children(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """(name, is a folder, milliseconds of the last change) of what a folder holds; none if it is missing."""
    fs, place = _at(spark, path)
    if not fs.exists(place):
        return []
    return sorted((s.getPath().getName(), s.isDirectory(), s.getModificationTime()) for s in fs.listStatus(place))


def files_below(spark: SparkSession, path: str) -> list[str]:
    """Data files of a folder and the folders in it, relative to it; marker files are left out."""
    found = []
    for name, is_folder, _ in children(spark, path):
        if is_folder:
            found += [f"{name}/{below}" for below in files_below(spark, f"{path}/{name}")]
        elif not name.startswith(("_", ".")):
            found.append(name)
    return found


def move(spark: SparkSession, source: str, target: str) -> None:
    """Move a file or folder; repeated after a crash it ends the same way."""
    fs, old = _at(spark, source)
    _, new = _at(spark, target)
    if not fs.exists(old):
        if not fs.exists(new):
            raise FileNotFoundError(source)
        return
    fs.mkdirs(new.getParent())
    if fs.exists(new):  # a copy that was cut off
        fs.delete(new, True)
    if not fs.rename(old, new):
        raise OSError(f"cannot move {source} to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    fs, _ = _at(spark, path)
    _, part = _at(spark, f"{path}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    move(spark, f"{path}.part", path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _at(spark, path)
    opened = fs.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
    finally:
        opened.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)
