"""Ordered operators: anomaly, forecast, bounded histories, sparklines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from wattfold.functions.clock import clock_label
from wattfold.functions.rounding import READING_DIGITS, from_units, half_even, half_up, truthy, units
from wattfold.operators.hotkeys import HOT_ROWS, first_rows, over_last_rows, over_time_range
from wattfold.operators.latest import latest

# Rolling anomaly, forecast and history lengths.
ANOMALY_ROWS, ANOMALY_MIN = 8, 4
ANOMALY_HIGH, ANOMALY_LOW, ANOMALY_LOW_FLOOR = 1.5, 0.3, 10.0
FORECAST_ROWS, FORECAST_MIN = 4, 2
HISTORY_ROWS, SPARK_ROWS = 96, 24

Keys = Sequence[str]
BY: Keys = ("bid",)
ORDER: Keys = ("ts", "seq")


def _verdict(rows: DataFrame, *, min_n: int, hi: float, lo: float, lo_floor: float, digits: int) -> DataFrame:
    """_total and _count of the frame to anomaly_type, avg_kw and ratio."""
    kw, avg = F.col("kw"), F.col("_avg")
    mean = F.when(F.col("_count") >= min_n, from_units(F.col("_total"), F.col("_count"), digits))
    kind = F.when((avg > 0) & (kw > avg * hi), "high").when((avg > lo_floor) & (kw < avg * lo), "low")
    flagged = F.col("anomaly_type").isNotNull()
    return (
        rows.withColumn("_avg", mean)
        .withColumn("anomaly_type", kind)
        .withColumns({"avg_kw": F.when(flagged, half_even("_avg", 1)), "ratio": F.when(flagged, half_even("kw / _avg", 2))})
        .drop("_total", "_count", "_avg")
    )


def _framed(df: DataFrame, frame: WindowSpec, digits: int) -> DataFrame:
    """Sum and count of the loads in the frame; zeros are in the frame but do not count."""
    kw = F.col("kw")
    return df.withColumns(
        {
            "_total": F.sum(F.when(truthy(kw), units("kw", digits))).over(frame),
            "_count": F.count(F.when(truthy(kw), kw)).over(frame),
        }
    )


def rolling_anomaly(
    readings: DataFrame,
    *,
    by: Keys = BY,
    order: Keys = ORDER,
    n: int = ANOMALY_ROWS,
    min_n: int = ANOMALY_MIN,
    hi: float = ANOMALY_HIGH,
    lo: float = ANOMALY_LOW,
    lo_floor: float = ANOMALY_LOW_FLOOR,
    hours: float | None = None,
    digits: int = READING_DIGITS,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Adds anomaly_type (high, low or null), avg_kw and ratio against the last n rows, or
    with ``hours`` against that much time.

    The last n rows are taken first and zeros drop out after, so fewer than n may count. The
    current reading is part of its own average.
    """
    known = readings.filter(F.col("kw").isNotNull())
    if hours is None:
        rows = over_last_rows(
            known, by=by, order=order, n=n, hot_rows=hot_rows,
            add=lambda df, w: _framed(df, w.rowsBetween(-(n - 1), 0), digits),
        )
    else:
        span = int(hours * 3600)
        rows = over_time_range(
            known, by=by, ts=order[0], span_seconds=span, hot_rows=hot_rows,
            add=lambda df, w: _framed(df, w.rangeBetween(-span, 0), digits),
        )
    return _verdict(rows, min_n=min_n, hi=hi, lo=lo, lo_floor=lo_floor, digits=digits)


def deviation_percent(ratio: str = "ratio") -> Column:
    return half_up(f"({ratio} - 1D) * 100D").cast("bigint")


def wma_forecast(
    readings: DataFrame,
    *,
    by: Keys = BY,
    order: Keys = ORDER,
    n: int = FORECAST_ROWS,
    min_n: int = FORECAST_MIN,
    digits: int = READING_DIGITS,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Adds predicted_kw: the last n rows without zeros, weighted 1, 2, ... oldest first."""
    kw = F.col("kw")

    def add(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = df.withColumn("_u", F.when(truthy(kw), units("kw", digits)))  # null: does not count
        for back in range(1, n):
            df = df.withColumn(f"_u{back}", F.lag("_u", back).over(w))
        return df

    rows = over_last_rows(readings.filter(kw.isNotNull()), by=by, order=order, n=n, add=add, hot_rows=hot_rows)
    oldest_first = [F.col(f"_u{back}") for back in range(n - 1, 0, -1)] + [F.col("_u")]
    count: Column = F.lit(0)
    weighted: Column = F.lit(0).cast("bigint")
    for value in oldest_first:  # the weight of a value is how many values counted up to it
        count = count + F.when(value.isNotNull(), 1).otherwise(0)
        weighted = weighted + F.coalesce(value, F.lit(0)) * count
    weights = count * (count + 1) / F.lit(2)
    predicted = F.when(count >= min_n, from_units(weighted, weights, digits))
    rows = rows.withColumn("predicted_kw", predicted).withColumn("predicted_kw", half_even("predicted_kw", 1))
    return rows.drop("_u", *[f"_u{b}" for b in range(1, n)])


def last_n(
    readings: DataFrame,
    *,
    by: Keys = BY,
    order: Keys = ORDER,
    n: int = HISTORY_ROWS,
    value: str | None = None,
) -> DataFrame:
    """Latest n rows per key; with ``value``, nulls of it are dropped after the cut."""
    rows = first_rows(readings, by=by, order=[F.desc(c) for c in order], n=n).drop("_rank")
    return rows if value is None else rows.filter(F.col(value).isNotNull())


def sparkline(
    readings: DataFrame,
    *,
    by: Keys = BY,
    order: Keys = ORDER,
    n: int = SPARK_ROWS,
) -> DataFrame:
    """Last n loads per key as an array, oldest first (n bounds the array)."""
    rows = last_n(readings.filter(F.col("kw").isNotNull()), by=by, order=order, n=n)
    points = F.array_sort(F.collect_list(F.struct(*order, "kw")))
    return rows.groupBy(*by).agg(F.transform(points, lambda p: p["kw"]).alias("sparkline"))


def expand_sparkline(snapshots: DataFrame, *, step_min: int = 15) -> DataFrame:
    """bid, snap_ts, sparkline -> bid, ts, kw. The last point is at the snapshot's time,
    each one before it ``step_min`` minutes earlier."""
    at = F.posexplode("sparkline").alias("i", "kw")
    back = (F.col("n") - 1 - F.col("i")) * step_min
    return (
        snapshots.select("bid", "snap_ts", F.size("sparkline").alias("n"), at)
        .filter(F.col("kw").isNotNull())
        .select("bid", (F.col("snap_ts") - F.make_dt_interval(mins=back)).alias("ts"), "kw")
    )


def clock_fold(readings: DataFrame, *, by: Keys = BY, order: Keys = ORDER) -> DataFrame:
    """First reading per key and clock label (HH:mm), days folded together."""
    first = F.min(F.struct(*order, "kw"))
    return readings.groupBy(*by, clock_label(F.col("ts")).alias("label")).agg(first["kw"].alias("kw"))


def snapshot_asof(readings: DataFrame, *, t: str, by: Keys = BY, order: Keys = ORDER) -> DataFrame:
    """Last reading per key at or before ``t``; the range reaches the scan."""
    at = F.lit(t).cast(readings.schema["ts"].dataType)
    return latest(readings.filter(F.col("ts") <= at), by=by, order=order)


def last_labels(readings: DataFrame, *, n: int = HISTORY_ROWS) -> DataFrame:
    """The last n distinct clock labels (there are 1,440 at most)."""
    return readings.select(clock_label(F.col("ts")).alias("label")).distinct().orderBy(F.desc("label")).limit(n)
