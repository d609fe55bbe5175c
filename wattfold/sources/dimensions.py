"""Dimension tables from files: registry, meters, building attributes, floor shares, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattfold.operators.hotkeys import global_rank

REGISTRY_SCHEMA = "id STRING, name STRING, mac STRING, db STRING, meters ARRAY<STRING>"
METER_SCHEMA = "meter STRING, ord INT, name STRING, voltage STRING"
ATTRIBUTE_SCHEMA = """bid STRING, name STRING, department STRING, lat DOUBLE, lng DOUBLE, category STRING,
    year_built INT, floors INT"""
SHARE_SCHEMA = "floor STRING, meter STRING, share DOUBLE"
VOTE_SCHEMA = "building STRING, vote STRING, ts TIMESTAMP, voter STRING, seq BIGINT"
VOTES = ("hot", "ok", "cold")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, CSV with header or Parquet, told by the name."""
    reader = spark.read.schema(schema)
    if path.endswith(".csv"):
        return reader.option("header", True).csv(path)
    if path.endswith((".json", ".jsonl")):
        return reader.json(path)
    return reader.parquet(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows with their ordinal; the order of rows of one id is their priority.

    Rows without an ``ordinal`` of their own get their place: files by name, lines in order of the file, however Spark
    deals them out.
    """
    rows = _read(spark, path, f"{REGISTRY_SCHEMA}, ordinal BIGINT").select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    placed = global_rank(rows, order=[F.col("_file"), F.col("_block"), F.col("_at")], name="_place")
    return placed.withColumn("ordinal", F.coalesce("ordinal", "_place")).drop("_file", "_block", "_at", "_place")


def read_meters(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, METER_SCHEMA)


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, ATTRIBUTE_SCHEMA)


def read_shares(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, SHARE_SCHEMA)


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """Votes with one of the three known values."""
    return _read(spark, path, VOTE_SCHEMA).filter(F.col("vote").isin(*VOTES))
