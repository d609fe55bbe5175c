"""The driver's tables under canonical names.

reading   events: bid = user_id, kw = value, meter = event_type, seq = event_id
vote      events: building from the payload, voter = user_id, hot/ok/cold by type
building  customer with nation and region; part for names and floors
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Order of the meters of a building, and votes by event type.
METERS = ("error", "purchase", "signup", "view", "click")
VOTES = {"click": "hot", "view": "ok", "purchase": "cold"}


_schemas: dict[str, tuple[int, T.StructType]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its schema is read from the files once, and again when the table has been written anew."""
    path = f"{sf_dir}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    changed = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()
    if _schemas.get(path, (None,))[0] != changed:
        _schemas[path] = (changed, spark.read.parquet(path).schema)
    return spark.read.schema(_schemas[path][1]).parquet(path)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("bid"),
        "ts",
        F.col("value").alias("kw"),
        F.col("event_type").alias("meter"),
        F.col("event_id").alias("seq"),
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as readings: bid = supplier, kw = quantity, one reading per line."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("bid"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("kw")
    )


def campus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as campus cycles: total_kw = price, online = customer number."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("total_kw"),
        F.col("o_custkey").alias("online"),
        F.col("o_orderkey").alias("seq"),
    )


def as_votes(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    vote = F.coalesce(*[F.when(kind == k, v) for k, v in VOTES.items()])
    return events.filter(kind.isin(*VOTES)).select(
        F.concat(F.lit("b"), F.from_json("props", "k INT")["k"].cast("string")).alias("building"),
        F.col("user_id").alias("voter"),
        "ts",
        vote.alias("vote"),
        F.col("event_id").alias("seq"),
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_votes(table(spark, sf_dir, "events"))


def named_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as registry: bid, name, segment."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("bid"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("_nation")
    )


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as building dimension: bid, name, segment, nation, category (region)."""
    nation, region = (table(spark, sf_dir, t) for t in ("nation", "region"))
    places = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
    return named_buildings(spark, sf_dir).join(places, F.col("_nation") == F.col("n_nationkey"), "left").select(
        "bid", "name", "segment", F.col("n_name").alias("nation"), F.col("r_name").alias("category")
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")
