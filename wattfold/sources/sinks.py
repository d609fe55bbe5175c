"""Writers. Row layouts scale with the data; the nested documents hold one entry per
building in one row and are meant for page-sized registries, so their size is checked."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_ENTRIES = 10_000


def as_map(
    rows: DataFrame, key: str, value: Column, name: str, *, order: Column | None = None, limit: int = DOCUMENT_ENTRIES
) -> DataFrame:
    """All rows as one map in one row, entries by ``order`` (then key). Larger tables belong in ``write_rows``."""
    if rows.count() > limit:
        raise ValueError(f"more than {limit} entries do not fit one document; use write_rows")
    entry = F.struct(F.struct(F.lit(0) if order is None else order, F.col(key)).alias("o"), value.alias("v"))
    ordered = F.array_sort(
        F.collect_list(entry), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    )
    pairs = F.transform(ordered, lambda e: F.struct(e["o"][key].alias("k"), e["v"].alias("v")))
    return rows.agg(F.map_from_entries(pairs).alias(name))


def write_rows(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Row layout as Parquet."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_document(df: DataFrame, path: str) -> None:
    """One-row document as JSON, overwritten each cycle."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_daily(readings: DataFrame, path: str) -> None:
    """Adds a cycle's readings below date=... directories, which scans by date prune."""
    readings.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)


def write_days(readings: DataFrame, path: str, *, ts: str = "ts", cycle: str | None = None) -> None:
    """The daily store: rows below date=... (and cycle=...). What is there of the same date (and cycle) is replaced,
    other days stay as they are, so a day can be written again. Large days are spread over several tasks and files."""
    parts = ["date"] if cycle is None else ["date", cycle]
    rows = readings.withColumn("date", F.to_date(ts)).hint("rebalance", *parts)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def read_days(spark: SparkSession, path: str, *, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of the daily store in a range of dates, open on either side; other days' directories are not listed into the scan."""
    rows = spark.read.parquet(path)
    if start:
        rows = rows.filter(F.col("date") >= F.lit(start).cast("date"))
    return rows.filter(F.col("date") <= F.lit(end).cast("date")) if end else rows


def stored_days(spark: SparkSession, path: str) -> list[str]:
    """Dates that the store holds, sorted, from its directory names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(n.removeprefix("date=") for n in names if n.startswith("date=") and not n.endswith("__"))


# --- documents of any size ------------------------------------------------------------


def write_sharded(rows: DataFrame, path: str, *, key: str, value: Column, header: DataFrame | None = None, entries: int = DOCUMENT_ENTRIES) -> None:
    """A document of any number of entries: shards of about ``entries`` each, dealt by a hash of the key, and a manifest.

    A shard is one line of JSON with the map of its entries. The manifest, written last, names the folder of shards that
    counts, how many there are, how many entries they hold, and the header's fields.
    """
    spark = rows.sparkSession
    n = rows.count()
    shards = max(1, -(-n // entries))
    folder = f"shards-{uuid.uuid4().hex}"
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}).alias("v"))))
    dealt = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard")).agg(pairs.alias("pairs"))
    text = F.transform("pairs", lambda e: F.concat(_quoted(e["k"].cast("string")), F.lit(": "), F.substr(e["v"], F.lit(6), F.length(e["v"]) - 6)))
    line = F.concat(F.lit('{"shard": '), F.col("shard").cast("string"), F.lit(', "entries": {'), F.array_join(text, ", "), F.lit("}}"))
    dealt.select(line.alias("value")).write.text(f"{path}/{folder}")
    head = header if header is not None else spark.range(1).select()
    about = head.select(F.lit(folder).alias("folder"), F.lit(shards).alias("shards"), F.lit(n).alias("entries"), *[F.col(c) for c in head.columns])
    about.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/manifest")


def _quoted(text: Column) -> Column:
    """Text as a JSON string."""
    doc = F.to_json(F.struct(text.alias("k")))
    return F.substr(doc, F.lit(6), F.length(doc) - 6)


def read_sharded(spark: SparkSession, path: str, value: str, *, key: str = "bid") -> DataFrame:
    """The entries of a sharded document as rows (key, v). ``value`` is the DDL type of an entry."""
    folder = spark.read.json(f"{path}/manifest").first()["folder"]
    docs = spark.read.schema(f"shard INT, entries MAP<STRING, {value}>").json(f"{path}/{folder}")
    return docs.select(F.explode("entries").alias(key, "v"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/manifest")


def daily_document(cycle: DataFrame, current: DataFrame, *, id_col: str = "bid") -> DataFrame:
    """One reading of the daily archive: time, total_kw, online and the map of loads.

    ``cycle`` is the one-row campus total with its ``ts``.
    """
    loads = as_map(current.filter(F.col("kw").isNotNull()), id_col, F.col("kw"), "buildings")
    head = cycle.select(F.date_format("ts", "HH:mm").alias("time"), "total_kw", F.col("buildings_online").alias("online"))
    return head.withColumn("buildings", loads.scalar())
