"""Small files and folders on any Hadoop file system, through the session's own client."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    return (fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs), where, jvm  # without checksum files beside


def exists(spark: SparkSession, path: str) -> bool:
    fs, where, _ = _at(spark, path)
    return fs.exists(where)


def folders(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Sub-folders with a prefix, sorted; none if the folder does not exist. Any other failure is raised."""
    fs, where, _ = _at(spark, path)
    if not fs.exists(where):
        return []
    found = [s for s in fs.listStatus(where) if s.isDirectory() and s.getPath().getName().startswith(prefix)]
    return sorted(s.getPath().toString() for s in found)


def read(spark: SparkSession, path: str) -> str:
    fs, where, jvm = _at(spark, path)
    stream = fs.open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write(spark: SparkSession, path: str, text: str) -> None:
    """Written aside, flushed to the disks and renamed into place."""
    fs, where, jvm = _at(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    stream.write(bytearray(text.encode()))
    stream.hsync()
    stream.close()
    if fs.getUri().getScheme() == "file":
        os.replace(aside.toUri().getPath(), where.toUri().getPath())
        return
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)  # noqa: SLF001
    options[0] = overwrite
    context.rename(fs.makeQualified(aside), fs.makeQualified(where), options)


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file if there is none; whether it was created."""
    fs, where, _ = _at(spark, path)
    return fs.createNewFile(where)


def drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        fs, where, _ = _at(spark, path)
        fs.delete(where, True)
