"""Small files and folders of any file system that Spark's driver reaches."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, there = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(there)) if fs.exists(there) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, there = _at(spark, path)
    return fs.exists(there)


def delete(spark: SparkSession, path: str) -> None:
    fs, there = _at(spark, path)
    fs.delete(there, True)


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name and move it into place, so that nobody reads half of it."""
    fs, there = _at(spark, path)
    half = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "._half")
    out = fs.create(half, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(half, there):
        raise OSError(f"{path} is there already")


def read(spark: SparkSession, path: str) -> str:
    fs, there = _at(spark, path)
    if not fs.exists(there):
        raise FileNotFoundError(path)
    stream = fs.open(there)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
