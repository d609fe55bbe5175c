"""Connected components over an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattfold.session import scratch_path


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: lineage ends, and sizes are known to the planner."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.selectExpr("count(*)", "sum(cast(xxhash64(u, v) as decimal(20)))").first())


def _with_least(edges: DataFrame) -> DataFrame:
    return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v, of one type): root is the smallest node of its component.

    Large star, then small star, until the edges stay as they are: the edges then tie each node to its root, once. Each
    star is one shuffle by ``u`` and a minimum over the sorted rows, which spill; a round is written to the shared folder
    and nothing is collected. An edge may come several times within a round; the edges never get more.
    """
    now = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").selectExpr("v u", "least(u, m) v")
        small = _with_least(large.repartition("u").distinct())
        now = stored(small.selectExpr("if(v = m, u, v) u", "m v"), "edges")
    return now.selectExpr("u node", "v root").unionAll(now.selectExpr("v node", "v root").distinct())
