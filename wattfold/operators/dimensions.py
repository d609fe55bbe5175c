"""Dimension and allocation joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattfold.functions.rounding import READING_DIGITS, from_units, units

# Broadcast or shuffle is left to the planner: it knows table sizes, and adaptive
# execution measures the ones it does not know and splits skewed shuffles.


def registry_left_live(registry: DataFrame, current: DataFrame, *, on: str = "bid") -> DataFrame:
    """Every registered building, load null where none is known."""
    return registry.join(current.select(on, "kw", "ts"), on, "left")


def with_names(df: DataFrame, names: DataFrame, *, on: str = "bid") -> DataFrame:
    """Display name, the id where there is none."""
    return df.join(names.select(on, F.col("name").alias("_name")), on, "left").withColumn(
        "name", F.coalesce("_name", F.col(on).cast("string"))
    ).drop("_name")


def floor_allocation(
    readings: DataFrame, shares: DataFrame, *, by: tuple[str, ...] = (), digits: int = READING_DIGITS
) -> DataFrame:
    """Load of a floor: sum over meters of load times the floor's share of the meter."""
    per_meter = readings.groupBy(*by, "meter").agg(F.sum(units("kw", digits)).alias("_u"))
    # Meters are added up before the many-to-many join; shares are whole percents.
    pct = F.floor(F.col("share") * 100.0 + 0.5).cast("bigint")
    return (
        per_meter.join(shares, "meter")
        .groupBy(*by, "floor")
        .agg(from_units(F.sum(F.col("_u") * pct), digits=digits + 2).alias("kw"))
    )


def share_check(shares: DataFrame) -> DataFrame:
    """Meters whose shares do not add up to 1."""
    return (
        shares.groupBy("meter")
        .agg(F.sum(F.floor(F.col("share") * 100.0 + 0.5).cast("bigint")).alias("pct"))
        .filter(F.col("pct") != 100)
    )


def shared_meters(registry: DataFrame) -> DataFrame:
    """(mac, meter) pairs that feed more than one building, whose totals count twice."""
    feeds = registry.select("id", "mac", F.explode("meters").alias("meter")).distinct()
    return feeds.groupBy("mac", "meter").agg(
        F.count("id").alias("buildings"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    ).filter(F.col("buildings") > 1)


def union_readings(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; a measure a part lacks is null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def union_labels(*parts: DataFrame) -> DataFrame:
    return union_readings(*parts).distinct()


def report_for(reports: DataFrame, *, as_of: str, week_offset: int = 0, date: str = "report_date") -> DataFrame:
    """Archived report ``week_offset`` weeks back; the future clamps to the current one."""
    day = F.date_add(F.lit(as_of).cast("date"), 7 * min(week_offset, 0))
    return reports.filter(F.col(date) == day)
