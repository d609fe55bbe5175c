"""JSON stores: daily archive, snapshots, history, reports. Objects keyed by building
are read as maps, so that the schema does not grow with the buildings."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattfold.functions.clock import iso_time
from wattfold.sources.exports import POWER_MEASURES, WATER_MEASURES

DAILY_SCHEMA = """date STRING,
    readings ARRAY<STRUCT<time STRING, total_kw DOUBLE, online INT, buildings MAP<STRING, DOUBLE>>>"""
ANOMALY_TYPE = "STRUCT<type STRING, current DOUBLE, avg DOUBLE, ratio DOUBLE>"
SNAPSHOT_SCHEMA = f"""generated_at STRING, timestamp STRING, update_interval_min INT, buildings_total INT,
    buildings_online INT, total_kw DOUBLE, total_daily_kwh BIGINT, total_daily_cost DOUBLE,
    total_daily_co2_kg DOUBLE, anomaly_count INT, anomalies MAP<STRING, {ANOMALY_TYPE}>,
    buildings MAP<STRING, STRUCT<name STRING, kw DOUBLE, status STRING, timestamp STRING, mac STRING,
        meter STRING, predicted_kw DOUBLE, anomaly {ANOMALY_TYPE}, sparkline ARRAY<DOUBLE>,
        est_daily_kwh BIGINT, est_daily_cost DOUBLE, est_daily_co2_kg DOUBLE>>,
    _corrupt STRING"""
HISTORY_TYPE = "MAP<STRING, ARRAY<STRUCT<kw DOUBLE, ts STRING, t STRING>>>"
INDEX_SCHEMA = "days ARRAY<STRING>, updated STRING"
_STAT = "STRUCT<mean DOUBLE, std DOUBLE, n BIGINT>"
_TIER = f"MAP<STRING, {_STAT}>"
BASELINE_SCHEMA = f"""_doc STRING, _generated_at STRING, _source_files ARRAY<STRING>,
    _min_samples MAP<STRING, INT>,
    buildings MAP<STRING, STRUCT<tier1 {_TIER}, tier2 {_TIER}, tier3 {_TIER}, tier4 {_STAT}>>"""
REPORT_SCHEMA = """generated_at STRING,
    period STRUCT<start STRING, end STRING, days INT, total_readings INT>,
    campus_summary STRUCT<avg_kw DOUBLE, peak_kw DOUBLE, min_kw DOUBLE, total_kwh DOUBLE, total_cost DOUBLE,
        total_co2_kg DOUBLE, total_co2_tons DOUBLE, trees_equivalent BIGINT>,
    daily_breakdown ARRAY<STRUCT<date STRING, day STRING, avg_kw DOUBLE, peak_kw DOUBLE, peak_time STRING,
        min_kw DOUBLE, readings_count INT, avg_online INT, est_kwh DOUBLE, est_cost DOUBLE, est_co2_kg DOUBLE>>,
    building_rankings MAP<STRING, STRUCT<avg_kw DOUBLE, peak_kw DOUBLE, min_kw DOUBLE, readings INT,
        est_weekly_kwh DOUBLE, est_weekly_cost DOUBLE, est_weekly_co2_kg DOUBLE>>"""
STAT_TYPE = "STRUCT<current DOUBLE, min DOUBLE, max DOUBLE, avg DOUBLE, count BIGINT, peak_time STRING>"
_POWER = ", ".join(f"{m} DOUBLE" for m in POWER_MEASURES)
_WATER = ", ".join(f"{m} DOUBLE" for m in WATER_MEASURES)
_FLOW = f"""STRUCT<status STRING, latest STRUCT<timestamp STRING, {_WATER}>,
        stats_today STRUCT<water_rate {STAT_TYPE}, steam_rate {STAT_TYPE}>,
        timeseries_water ARRAY<STRUCT<t STRING, v DOUBLE>>>"""
INTERIOR_SCHEMA = f"""generated_at STRING, building MAP<STRING, STRING>,
    meters MAP<STRING, STRUCT<name STRING, voltage STRING, status STRING, latest STRUCT<timestamp STRING, {_POWER}>,
        stats_today STRUCT<kw {STAT_TYPE}, power_factor {STAT_TYPE}, current {STAT_TYPE}>,
        timeseries_kw ARRAY<STRUCT<t STRING, v DOUBLE>>>>,
    water {_FLOW}, water_meters MAP<STRING, {_FLOW}>,
    summary STRUCT<total_kw_now DOUBLE, meters_online BIGINT>"""


def _documents(spark: SparkSession, path: str, schema: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", True)
    if "_corrupt STRING" in schema:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(path)


def read_daily(spark: SparkSession, path: str, *, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row per reading: date, ts, total_kw, online, buildings (map).

    A date range, open on either side, is turned into file names, so other days' files are not read.
    """
    glob = "*-*-*.json"
    if start and end:
        first, last = date.fromisoformat(start), date.fromisoformat(end)
        days = [first + timedelta(days=i) for i in range((last - first).days + 1)]
        glob = "{" + ",".join(f"{d}.json" for d in days) + "}"
    docs = _documents(spark, path, DAILY_SCHEMA, glob)
    if start:
        docs = docs.filter(F.col("_metadata.file_name") >= f"{start}.json")
    if end:
        docs = docs.filter(F.col("_metadata.file_name") <= f"{end}.json")
    return docs.select(F.to_date("date").alias("date"), F.inline("readings")).select(
        "date",
        F.to_timestamp_ntz(F.concat_ws(" ", F.col("date").cast("string"), "time"), F.lit("yyyy-MM-dd HH:mm"))
        .alias("ts"),
        "total_kw",
        "online",
        "buildings",
    )


def building_readings(daily: DataFrame) -> DataFrame:
    """Daily archive rows to one row per building reading: date, ts, bid, kw."""
    return daily.select("date", "ts", F.explode("buildings").alias("bid", "kw"))


def read_daily_index(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path, INDEX_SCHEMA).select(F.explode("days").alias("day"))


def checked_snapshots(spark: SparkSession, path: str, *, glob: str | None = "[0-9]*-*-*.json") -> DataFrame:
    """Every snapshot file with ``file``, its fields, snap_ts and ``problem``: null for a good one, else ``empty``,
    ``unreadable``, ``no buildings`` or ``no time``. No file drops out; empty ones come from the listing."""
    docs = _documents(spark, path, SNAPSHOT_SCHEMA, glob)
    stamp = F.coalesce(F.nullif(F.col("generated_at"), F.lit("")), F.nullif(F.col("timestamp"), F.lit("")))
    listed = [(p,) for p in docs.inputFiles()]  # the reader's own list, which names empty files too
    files = spark.createDataFrame(listed, "_path string").withColumn("file", F.element_at(F.split("_path", "/"), -1))
    docs = docs.withColumn("_path", F.input_file_name()).withColumn("snap_ts", iso_time(stamp))
    problem = (
        F.when(F.col("_read").isNull(), "empty")
        .when(F.col("_corrupt").isNotNull(), "unreadable")
        .when(F.col("buildings").isNull(), "no buildings")
        .when(F.col("snap_ts").isNull(), "no time")
    )
    found = files.join(docs.withColumn("_read", F.lit(True)), "_path", "left").withColumn("problem", problem)
    return found.withColumnRenamed("_path", "path").drop("_read")


def read_snapshots(spark: SparkSession, path: str, *, glob: str | None = "[0-9]*-*-*.json") -> DataFrame:
    """Good snapshot documents with snap_ts and file; ``rejected_snapshots`` has the others."""
    return checked_snapshots(spark, path, glob=glob).filter(F.col("problem").isNull()).drop("_corrupt", "problem", "path")


def rejected_snapshots(spark: SparkSession, path: str, *, glob: str | None = "[0-9]*-*-*.json") -> DataFrame:
    """The quarantine: file, problem and the text of unreadable ones."""
    bad = checked_snapshots(spark, path, glob=glob).filter(F.col("problem").isNotNull())
    return bad.select("path", "file", "problem", F.col("_corrupt").alias("payload"))


def snapshot_buildings(snapshots: DataFrame) -> DataFrame:
    """One row per building of each snapshot: snap_ts, bid and the building's fields."""
    rows = snapshots.select("snap_ts", "file", F.explode("buildings").alias("bid", "b"))
    return rows.select("snap_ts", "file", "bid", "b.*")


def source_files(snapshots: DataFrame) -> DataFrame:
    """Sorted distinct file names."""
    return snapshots.select("file").distinct().orderBy("file")


def _history_text(spark: SparkSession, path: str) -> DataFrame:
    """file, value, points (null where the text is no history)."""
    try:
        text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    except AnalysisException:
        text = spark.range(0).select(F.lit("").alias("file"), F.lit("").alias("value"))
    return text.withColumn("points", F.from_json("value", HISTORY_TYPE, {"mode": "PERMISSIVE"}))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """bid, ts (text), t, kw, pos; no rows when the file is missing or unreadable, see ``rejected_histories``."""
    points = _history_text(spark, path).select(F.explode("points").alias("bid", "points"))
    return points.select("bid", F.posexplode("points").alias("pos", "p")).select("bid", "pos", "p.ts", "p.t", "p.kw")


def rejected_histories(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold no history: file, problem (``empty`` or ``unreadable``), payload."""
    bad = _history_text(spark, path).filter(F.col("points").isNull())
    problem = F.when(F.trim("value") == "", "empty").otherwise("unreadable")
    return bad.select("file", problem.alias("problem"), F.col("value").alias("payload"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path, REPORT_SCHEMA)


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """Nested baseline document back to one row per building with its tier maps."""
    docs = _documents(spark, path, BASELINE_SCHEMA)
    return docs.select(F.explode("buildings").alias("bid", "b")).select("bid", "b.*")


def read_interior(spark: SparkSession, path: str) -> DataFrame:
    """Building-data document to one row per meter."""
    docs = _documents(spark, path, INTERIOR_SCHEMA)
    return docs.select("generated_at", F.explode("meters").alias("meter", "m")).select("generated_at", "meter", "m.*")


def read_interior_water(spark: SparkSession, path: str) -> DataFrame:
    """Building-data document to one row per water meter; a document that names none has one row without a meter."""
    docs = _documents(spark, path, INTERIOR_SCHEMA)
    named = docs.select("generated_at", F.explode("water_meters").alias("meter", "w"))
    alone = docs.where(F.coalesce(F.size("water_meters"), F.lit(-1)) < 1).select("generated_at", F.lit(None).cast("string").alias("meter"), F.col("water").alias("w"))
    return named.unionByName(alone.where("w is not null")).select("generated_at", "meter", "w.*")


def read_interior_summary(spark: SparkSession, path: str) -> DataFrame:
    """Building-data document to its summary, one row."""
    return _documents(spark, path, INTERIOR_SCHEMA).select("generated_at", "building", "summary.*")
