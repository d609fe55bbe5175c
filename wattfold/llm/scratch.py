"""Scratch tables of the operators: below the shared folder, removed as soon as nobody needs them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wattfold.session import scratch_path


def _path(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    at, files = _path(spark, path)
    files.delete(at, True)


def folder(spark: SparkSession, name: str) -> str:
    """A new path; what lies there when the application ends goes with it."""
    path = scratch_path(spark, name)
    at, files = _path(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def written(frame: DataFrame, path: str, *parts: str) -> DataFrame:
    """The frame as a table at ``path``, read back: lineage ends, and a lost executor costs no more than a read."""
    frame.write.partitionBy(*parts).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def bucketed(frame: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """The frame as a table at ``path`` in ``buckets`` sorted files by ``key``: joins on the key don't shuffle it again."""
    name = f"scratch_{uuid.uuid4().hex}"
    dealt = frame.repartition(buckets, key)
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return frame.sparkSession.table(name)
