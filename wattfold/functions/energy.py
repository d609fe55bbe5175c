"""Energy, cost and CO2 estimates, status and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattfold.functions.rounding import half_even, truthy

# Tariff, grid factor and the figures the published estimates use.
COST_PER_KWH = 0.15
CO2_PER_KWH = 0.21
CO2_KG_PER_TREE = 21.7
KWH_PER_HOME_DAY = 30.0
DEFAULT_FLOORS = 3
DEFAULT_MAX_KW = 500.0


def daily_estimates(kw: str, cost: float = COST_PER_KWH, co2: float = CO2_PER_KWH) -> dict[str, Column]:
    """Day figures for the load in column ``kw``; null when there is no load."""
    on = truthy(F.col(kw))
    kwh = f"{kw} * 24D"
    return {
        "est_daily_kwh": F.when(on, half_even(kwh).cast("bigint")),
        "est_daily_cost": F.when(on, half_even(f"{kwh} * {cost}D", 2)),
        "est_daily_co2_kg": F.when(on, half_even(f"{kwh} * {co2}D", 1)),
    }


def status(kw: Column) -> Column:
    return F.when(truthy(kw), "online").otherwise("offline")


def load_band(kw: Column) -> Column:
    """Absolute load: above 200 high, above 100 mid, else low."""
    return F.when(kw > 200, "high").when(kw > 100, "mid").otherwise("low")


def legend_band(kw: Column) -> Column:
    """Map legend: none without load, then below 50, up to 200, above 200."""
    return F.when(~truthy(kw), "none").when(kw < 50, "low").when(kw <= 200, "mid").otherwise("high")


def efficiency_band(kw_per_floor: Column) -> Column:
    return F.when(kw_per_floor > 50, "high").when(kw_per_floor > 20, "mid").otherwise("low")


def relative_band(kw: Column, max_kw: Column) -> Column:
    """Load against the highest current load, in five steps; ``none`` without load."""
    share = F.least(kw / max_kw, F.lit(1.0))
    return (
        F.when(~truthy(kw), "none")
        .when(share < 0.15, "very_low")
        .when(share < 0.35, "low")
        .when(share < 0.55, "mid")
        .when(share < 0.75, "high")
        .otherwise("very_high")
    )


def power_factor(pf: Column) -> Column:
    """Meters report a ratio or a percentage; anything from 2 up is a percentage."""
    return F.when(F.abs(pf) < 2, pf).otherwise(pf / 100.0)
