"""Folders on the shared file system, wherever it is: found, listed and removed through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _at(spark, path)
    return files.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder, in order; none where there is no folder."""
    where, files = _at(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    where, files = _at(spark, path)
    files.delete(where, True)


def versions(spark: SparkSession, path: str, prefix: str = "v") -> list[int]:
    """The numbers of a folder's versions, `v1`, `v2` and so on, in order."""
    return sorted(int(n[len(prefix) :]) for n in names(spark, path) if n.startswith(prefix) and n[len(prefix) :].isdigit())
