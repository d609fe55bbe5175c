"""Latest readings and the resolution of buildings from their meters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattfold.functions.energy import KWH_PER_HOME_DAY, daily_estimates, status
from wattfold.functions.names import strip_legacy
from wattfold.functions.rounding import exact_total, half_even, half_up


def latest(readings: DataFrame, *, by: Sequence[str], order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Last row per key: one map-side combined aggregate, no window over histories.

    Rows that tie on ``order`` are told apart by their other columns.
    """
    rest = [c for c in readings.columns if c not in by]
    row = F.struct(*order, *[c for c in rest if c not in order])
    return readings.groupBy(*by).agg(F.max(row).alias("_row")).select(*by, *[F.col("_row")[c].alias(c) for c in rest])


def resolve_buildings(registry: DataFrame, latest_by_meter: DataFrame) -> DataFrame:
    """Load of each building: first meter in its list that has one.

    ``registry``: id, ordinal, name, mac, meters (array in priority order). An id may
    come twice; the later row is used only if the earlier one has no load at all.
    ``latest_by_meter``: mac, meter, kw, ts. Buildings without a load stay, with the time
    at which their last listed meter reported; so do those without any meter.
    """
    tried = (
        registry.select("id", "ordinal", "name", "mac", F.posexplode_outer("meters").alias("pos", "meter"))
        .join(latest_by_meter.select("mac", "meter", "kw", "ts"), ["mac", "meter"], "left")
    )
    silent = F.col("kw").isNull()
    pick = F.struct(
        silent.alias("silent"),
        "ordinal",
        F.when(silent, -F.col("pos")).otherwise(F.col("pos")).alias("turn"),
        "name",
        "mac",
        F.when(~silent, F.col("meter")).alias("meter"),
        "kw",
        "ts",
    )
    return (
        tried.groupBy("id")
        .agg(F.min(pick).alias("r"))
        .select("id", strip_legacy(F.col("r.name")).alias("name"), "r.mac", "r.meter", "r.kw", "r.ts")
    )


def meter_status(meters: DataFrame, latest_by_meter: DataFrame, *, on: Sequence[str] = ("meter",)) -> DataFrame:
    """Every known meter, offline when nothing was read from it."""
    seen = latest_by_meter.select(*on, "kw", F.lit(True).alias("_seen"))
    return meters.join(seen, list(on), "left").select(
        *meters.columns,
        "kw",
        F.when(F.col("_seen"), "online").otherwise("offline").alias("status"),
    )


def offline(registry: DataFrame, current: DataFrame, *, on: str = "id") -> DataFrame:
    """Registry rows that no current load belongs to."""
    return registry.join(current.filter(F.col("kw").isNotNull()).select(on), on, "left_anti")


def online(registry: DataFrame, current: DataFrame, *, on: str = "id") -> DataFrame:
    return registry.join(current.filter(F.col("kw").isNotNull()).select(on), on, "left_semi")


def silent_since(readings: DataFrame, *, by: Sequence[str], as_of: str, hours: int = 2) -> DataFrame:
    """Keys whose last reading is older than ``hours`` at ``as_of``."""
    last = readings.groupBy(*by).agg(F.max("ts").alias("last_ts"))
    limit = F.lit(as_of).cast(readings.schema["ts"].dataType) - F.make_dt_interval(hours=F.lit(hours))
    return last.filter(F.col("last_ts") < limit)


def with_estimates(current: DataFrame, *, kw: str = "kw") -> DataFrame:
    return current.withColumns({"status": status(F.col(kw)), **daily_estimates(kw)})


def campus_total(current: DataFrame) -> DataFrame:
    """One row: total load, counts, and the estimates from the rounded total."""
    totals = current.agg(
        exact_total("kw", "kw <> 0", empty=0.0).alias("total_kw"),
        F.count("kw").alias("buildings_online"),
        F.count(F.lit(1)).alias("buildings_total"),
    ).withColumn("total_kw", half_even("total_kw", 1))
    estimates = daily_estimates("total_kw")
    return totals.withColumns(
        {
            "total_daily_kwh": F.coalesce(estimates["est_daily_kwh"], F.lit(0).cast("bigint")),
            "total_daily_cost": F.coalesce(estimates["est_daily_cost"], F.lit(0.0)),
            "total_daily_co2_kg": F.coalesce(estimates["est_daily_co2_kg"], F.lit(0.0)),
        }
    )


def home_equivalents(total: DataFrame, *, kwh: str = "total_daily_kwh") -> DataFrame:
    """Daily energy in MWh (one decimal) and as a number of average homes."""
    return total.withColumns(
        {
            "daily_mwh": half_up(f"{kwh} / 1000D", 1),
            "homes": half_up(f"{kwh} / {KWH_PER_HOME_DAY}D").cast("bigint"),
        }
    )
