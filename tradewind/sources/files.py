"""Paths on whatever file system Spark is configured for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_sizes(spark: SparkSession, path: str) -> list[int]:
    """Sizes of the files a path or glob names; a directory counts as its whole content."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(target)
    if found is None:
        return []
    return [system.getContentSummary(status.getPath()).getLength() for status in found]


def exists(spark: SparkSession, path: str) -> bool:
    return bool(file_sizes(spark, path))
