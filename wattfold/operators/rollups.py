"""Statistics and rollups: series, days, weeks, categories, timelines, top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattfold.functions.clock import clock_label
from wattfold.functions.energy import (
    CO2_KG_PER_TREE,
    CO2_PER_KWH,
    COST_PER_KWH,
    DEFAULT_FLOORS,
    DEFAULT_MAX_KW,
    efficiency_band,
    relative_band,
)
from wattfold.functions.rounding import exact_mean, exact_parts, exact_total, half_even, half_up, join_parts, truthy
from wattfold.operators.hotkeys import HOT_ROWS, row_position
from wattfold.operators.rolling import clock_fold


def series_stats(
    readings: DataFrame,
    *,
    by: Sequence[str],
    value: str = "kw",
    order: Sequence[str] = ("ts", "seq"),
) -> DataFrame:
    """current, min, max, avg, count and the time of the first maximum, nulls left out."""
    v = F.col(value)
    stats = (
        readings.filter(v.isNotNull())
        .groupBy(*by)
        .agg(
            F.max(F.struct(*order, v.alias("v")))["v"].alias("current"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            exact_mean(value).alias("avg"),
            F.count(v).alias("count"),
            F.min(F.struct((-v).alias("v"), *order))[order[0]].alias("peak_time"),
        )
    )
    return stats.withColumns({c: half_even(c, 2) for c in ("min", "max", "avg")})


def interior_summary(latest_by_meter: DataFrame, meters: Sequence[str]) -> DataFrame:
    """One row: total of the latest loads, meters with a load, and the load of each meter."""
    kw = F.col("kw")
    return latest_by_meter.agg(
        exact_total("kw", "kw <> 0", empty=0.0).alias("total_kw_now"),
        F.count(F.when(truthy(kw), kw)).alias("meters_online"),
        *[F.max(F.when(F.col("meter") == m, kw)).alias(f"kw_{m}") for m in meters],
    ).withColumn("total_kw_now", half_even("total_kw_now", 2))


def cross_meter_peak(stats: DataFrame, *, meter: str = "meter", ordinal: str = "ord") -> DataFrame:
    """Sum of current and average loads, and the highest peak with its meter and time."""
    rank = F.struct(-F.col("max"), ordinal)
    out = stats.agg(
        exact_total("current").alias("total_kw"),
        exact_total("avg").alias("total_avg_kw"),
        F.max("max").alias("peak_kw"),
        F.min_by(meter, rank).alias("peak_meter"),
        F.min_by("peak_time", rank).alias("peak_time"),
    )
    return out.withColumns({c: half_up(c) for c in ("total_kw", "total_avg_kw", "peak_kw")})


# --- days and weeks -------------------------------------------------------------------


def campus_readings(building_readings: DataFrame) -> DataFrame:
    """Building loads of one cycle added up: ts, total_kw, online."""
    cycles = building_readings.groupBy("ts").agg(
        exact_total("kw", "kw <> 0", empty=0.0).alias("total_kw"), F.count("kw").alias("online")
    )
    return cycles.withColumn("total_kw", half_even("total_kw", 1))


def daily_summary(
    readings: DataFrame,
    *,
    date: Column | None = None,
    seq: Sequence[str] = (),
) -> DataFrame:
    """Per day: average, peak with its first time, minimum, counts, and the estimates.

    ``readings``: ts, total_kw, online. Energy comes from the rounded average, cost and
    CO2 from the rounded energy. A day whose totals are all empty keeps its row with zeros.
    """
    kw, on = F.col("total_kw"), F.col("online")
    loaded = truthy(kw)
    peak = F.min(F.when(loaded, F.struct((-kw).alias("v"), F.col("ts"), *seq)))
    out = readings.groupBy((F.to_date("ts") if date is None else date).alias("date")).agg(
        exact_mean("total_kw", "total_kw <> 0").alias("avg_kw"),
        F.max(F.when(loaded, kw)).alias("peak_kw"),
        peak["ts"].alias("peak_time"),
        F.min(F.when(loaded, kw)).alias("min_kw"),
        F.count(F.lit(1)).alias("readings_count"),
        F.avg(F.when(truthy(on), on)).alias("avg_online"),
    )
    rounded = out.withColumns(
        {
            **{c: F.coalesce(half_even(c, 1), F.lit(0.0)) for c in ("avg_kw", "peak_kw", "min_kw")},
            "avg_online": F.coalesce(half_even("avg_online"), F.lit(0.0)).cast("bigint"),
            "peak_time": F.coalesce(clock_label(F.col("peak_time")), F.lit("")),
            "day": F.date_format("date", "EEEE"),
        }
    )
    return rounded.withColumn("est_kwh", half_even("avg_kw * 24D")).withColumns(
        {
            "est_cost": half_even(f"est_kwh * {COST_PER_KWH}D", 2),
            "est_co2_kg": half_even(f"est_kwh * {CO2_PER_KWH}D", 1),
        }
    )


def building_weekly(readings: DataFrame, *, by: Sequence[str] = ("bid",)) -> DataFrame:
    """Per building over positive loads; the week's figures use the unrounded average."""
    kw = F.col("kw")
    week = "avg_kw * 24D * 7D"
    return (
        readings.filter(kw > 0)
        .groupBy(*by)
        .agg(
            exact_mean("kw").alias("avg_kw"),
            F.max(kw).alias("peak_kw"),
            F.min(kw).alias("min_kw"),
            F.count(kw).alias("readings"),
        )
        .select(
            *by,
            *[half_even(c, 1).alias(c) for c in ("avg_kw", "peak_kw", "min_kw")],
            "readings",
            half_even(week).alias("est_weekly_kwh"),
            half_even(f"{week} * {COST_PER_KWH}D", 2).alias("est_weekly_cost"),
            half_even(f"{week} * {CO2_PER_KWH}D", 1).alias("est_weekly_co2_kg"),
        )
    )


def with_week_figures(weekly: DataFrame) -> DataFrame:
    """Energy of the days with data at the rounded average, and what follows from it."""
    co2 = f"total_kwh * {CO2_PER_KWH}D"
    return weekly.withColumn("total_kwh", half_even("avg_kw * 24D * days")).withColumns(
        {
            "total_cost": half_even(f"total_kwh * {COST_PER_KWH}D", 2),
            "total_co2_kg": half_even(co2, 1),
            "total_co2_tons": half_even(f"{co2} / 1000D", 2),
            "trees_equivalent": half_even(f"{co2} / {CO2_KG_PER_TREE}D").cast("bigint"),
        }
    )


def campus_week(
    readings: DataFrame,
    *,
    as_of: str | None = None,
    days: int = 7,
    by: Sequence[Column] = (),
) -> DataFrame:
    """Average over readings (not over days), period, and totals for the days that have data.

    With ``as_of`` only the ``days`` days up to it count; with ``by`` there is one row per group.
    """
    if as_of is not None:
        end = F.lit(as_of).cast("date")
        lo = F.date_sub(end, days - 1).cast(readings.schema["ts"].dataType)
        hi = F.date_add(end, 1).cast(readings.schema["ts"].dataType)
        readings = readings.filter((F.col("ts") >= lo) & (F.col("ts") < hi))
    kw = F.col("total_kw")
    day = F.to_date("ts")
    # First per group and day, then per group: no distinct over raw rows.
    loaded = truthy(kw)
    per_day = readings.groupBy(*by, day.alias("_day")).agg(
        *[F.expr(f"sum({part}) FILTER (WHERE total_kw <> 0)").alias(f"_p{i}") for i, part in enumerate(exact_parts("total_kw"))],
        F.count(F.when(loaded, kw)).alias("_count"),
        F.max(F.when(loaded, kw)).alias("_max"),
        F.min(F.when(loaded, kw)).alias("_min"),
    )
    groups = [c for c in per_day.columns if not c.startswith("_")]
    total = join_parts(*[f"sum(_p{i})" for i in range(3)])
    out = per_day.groupBy(*groups).agg(
        F.min("_day").alias("period_start"),
        F.max("_day").alias("period_end"),
        F.count("_day").alias("days"),
        F.sum("_count").alias("total_readings"),
        F.expr(f"{total} / nullif(sum(_count), 0)").alias("avg_kw"),
        F.max("_max").alias("peak_kw"),
        F.min("_min").alias("min_kw"),
    )
    rounded = {c: F.coalesce(half_even(c, 1), F.lit(0.0)) for c in ("avg_kw", "peak_kw", "min_kw")}
    return with_week_figures(out.withColumns(rounded))


def week_over_week(readings: DataFrame) -> DataFrame:
    """Weekly average (weeks start on Monday) against the week before it in the data."""
    weekly = campus_week(readings, by=[F.to_date(F.date_trunc("week", "ts")).alias("week")])
    w = Window.orderBy("week")  # one row per calendar week
    return (
        weekly.select("week", "avg_kw")
        .withColumn("prev_avg_kw", F.lag("avg_kw").over(w))
        .withColumn("change_kw", half_even("avg_kw - prev_avg_kw", 1))
        .withColumn(
            "change_pct",
            F.when(F.col("prev_avg_kw") != 0, half_even("(avg_kw - prev_avg_kw) / prev_avg_kw * 100D", 1)),
        )
    )


def day_index(readings: DataFrame) -> DataFrame:
    return readings.select(F.to_date("ts").alias("date")).distinct().orderBy("date")


# --- categories, efficiency, bands ----------------------------------------------------


def category_rollup(current: DataFrame, categories: DataFrame, *, on: str = "bid") -> DataFrame:
    """Load per category (``Other`` when unknown), rounded, with its share of the campus load."""
    per = (
        current.join(categories.select(on, "category"), on, "left")
        .groupBy(F.coalesce("category", F.lit("Other")).alias("category"))
        .agg(exact_total("kw", "kw <> 0", empty=0.0).alias("_kw"))
    )
    whole = Window.partitionBy()  # over one row per category
    return (
        per.withColumn("_all", F.sum("_kw").over(whole))
        .withColumn("_all", half_even("_all", 1))
        .filter(F.col("_kw") > 0)
        .withColumn("kw", half_up("_kw"))
        .select("category", "kw", half_up("kw / _all * 100D").cast("bigint").alias("share_pct"))
    )


def efficiency(current: DataFrame, attributes: DataFrame, *, on: str = "bid") -> DataFrame:
    """Load per floor of the buildings that have a load; three floors where unknown."""
    floors = F.coalesce("floors", F.lit(DEFAULT_FLOORS))
    return (
        current.filter(F.col("kw").isNotNull())
        .join(attributes.select(on, "floors", "year_built"), on, "left")
        .withColumn("floors", floors)
        .withColumn("kw_per_floor", half_up("kw / floors", 1))
        .withColumn("efficiency_band", efficiency_band(F.col("kw_per_floor")))
    )


def avg_efficiency(per_floor: DataFrame) -> DataFrame:
    """Mean of the rounded per-floor loads."""
    mean = per_floor.agg(exact_mean("kw_per_floor").alias("avg_kw_per_floor"), F.count("kw_per_floor").alias("buildings"))
    return mean.withColumn("avg_kw_per_floor", F.coalesce(half_up("avg_kw_per_floor", 1), F.lit(0.0)))


def age_vs_energy(per_floor: DataFrame) -> DataFrame:
    return per_floor.filter(truthy(F.col("year_built")))


def with_relative_band(current: DataFrame, *, value: str = "kw", default_max: float = DEFAULT_MAX_KW) -> DataFrame:
    """Band against the highest current load. The maximum is a scalar subquery: one
    aggregate over the table, no join and no window over all rows."""
    top = current.select(F.coalesce(F.max(F.when(truthy(F.col(value)), F.col(value))), F.lit(default_max))).scalar()
    return current.withColumn("band", relative_band(F.col(value), top))


def top_k(df: DataFrame, *, by: str, tie: str, k: int = 10) -> DataFrame:
    return df.orderBy(F.desc(F.coalesce(by, F.lit(0.0))), tie).limit(k)


# --- timelines ------------------------------------------------------------------------


def load_timeline(
    readings: DataFrame,
    *,
    bucket: str = "15 minutes",
    by: str = "bid",
    order: Sequence[str] = ("ts", "seq"),
    clock_label_fold: bool = False,
) -> DataFrame:
    """Campus load over time: latest load of each building per bucket, added up.

    ``clock_label_fold`` keys on HH:mm without a date and takes each building's first
    reading, so that days fold onto each other.
    """
    if clock_label_fold:
        per = clock_fold(readings, by=[by], order=order).withColumnRenamed("label", "bucket")
    else:
        per = readings.groupBy(by, F.window("ts", bucket)["start"].alias("bucket")).agg(
            F.max(F.struct(*order, "kw"))["kw"].alias("kw")
        )
    totals = per.groupBy("bucket").agg(exact_total("kw", empty=0.0).alias("total"), F.count("kw").alias("buildings"))
    return totals.select("bucket", half_up("total").alias("kw"), "buildings")


def combine(
    readings: DataFrame,
    *,
    positional: bool = False,
    bucket: str = "15 minutes",
    meter: str = "meter",
    order: Sequence[str] = ("ts", "seq"),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Loads of several meters added up, by time bucket, or i-th with i-th when ``positional``."""
    if positional:
        placed = row_position(readings, by=[meter], order=order, name="position", hot_rows=hot_rows)
        key: Column | str = "position"
    else:
        placed = readings.groupBy(meter, F.window("ts", bucket)["start"].alias("bucket")).agg(
            F.max(F.struct(*order, "kw"))["kw"].alias("kw")
        )
        key = "bucket"
    return placed.groupBy(key).agg(exact_total("kw", empty=0.0).alias("combined_kw"), F.count("kw").alias("meters"))
