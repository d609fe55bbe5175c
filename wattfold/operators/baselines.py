"""Seasonal baselines in four tiers, their coverage, and the forecast lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattfold.functions.clock import in_zone, weekday, weekday_class
from wattfold.functions.rounding import READING_DIGITS, half_even, units

# Samples a cell needs in tiers 1-3, and the cells a full building has.
MIN_SAMPLES = 3
FULL_CELLS = {1: 168, 2: 48, 3: 24}


def dedupe_samples(samples: DataFrame) -> DataFrame:
    """Snapshots overlap; the same point of a building counts once."""
    return samples.dropDuplicates(["bid", "ts", "kw"])


def baselines(
    samples: DataFrame,
    *,
    tz: str = "UTC",
    min_n: int = MIN_SAMPLES,
    digits: int = READING_DIGITS,
) -> DataFrame:
    """bid, ts, kw -> bid, tier, wday, wclass, hr, mean, std, n.

    The raw samples are reduced once, to at most 168 cells per building of mergeable
    moments (count, sum, sum of squares, all exact); the grouping sets then run over the
    cells, so the fourfold expansion touches cells and not samples.
    """
    local = in_zone(F.col("ts"), tz)
    u = units("kw", digits)
    cells = (
        samples.filter(F.col("kw").isNotNull())
        .groupBy("bid", weekday(local).alias("wday"), F.hour(local).alias("hr"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(u).alias("_s"),
            F.sum(u.cast("decimal(19,0)") * u.cast("decimal(19,0)")).alias("_q"),
        )
        .withColumn("wclass", weekday_class(F.col("wday")))
    )
    tiers = cells.groupingSets(
        [["bid", "wday", "hr"], ["bid", "wclass", "hr"], ["bid", "hr"], ["bid"]], "bid", "wday", "hr", "wclass"
    ).agg(
        F.grouping_id().alias("_g"),
        F.sum("_n").alias("n"),
        F.sum("_s").alias("_s"),
        F.sum("_q").alias("_q"),
    )
    tier = F.when(F.col("_g") == 1, 1).when(F.col("_g") == 4, 2).when(F.col("_g") == 5, 3).otherwise(4)
    big = "decimal(38,0)"
    spread = F.col("n").cast(big) * F.col("_q").cast(big) - F.col("_s").cast(big) * F.col("_s").cast(big)
    n, scale = F.col("n").cast("double"), F.lit(float(10**digits))
    return (
        tiers.withColumn("tier", tier)
        .filter((F.col("tier") == 4) | (F.col("n") >= min_n))
        .withColumn("mean", F.col("_s").cast("double") / (scale * n))
        .withColumn("std", F.sqrt(spread.cast("double")) / (scale * n))
        .select("bid", "tier", "wday", "wclass", "hr", half_even("mean", 2).alias("mean"), half_even("std", 2).alias("std"), "n")
    )


def coverage(cells: DataFrame) -> DataFrame:
    """Per building: samples and filled cells per tier (of 168, 48 and 24)."""
    counts = cells.groupBy("bid").agg(
        F.max(F.when(F.col("tier") == 4, F.col("n"))).alias("samples"),
        *[F.count(F.when(F.col("tier") == t, 1)).alias(f"tier{t}_cells") for t in FULL_CELLS],
    )
    return counts.withColumns({f"tier{t}_pct": half_even(f"tier{t}_cells / {full}D * 100D", 1) for t, full in FULL_CELLS.items()})


def _stat() -> Column:
    return F.struct("mean", "std", "n")


def _tier_maps(cells: DataFrame, keys: dict[int, Column]) -> DataFrame:
    """One row per building with a map per tier; 168 + 48 + 24 entries bound each row."""
    maps = [
        F.map_from_entries(F.collect_list(F.when(F.col("tier") == t, F.struct(key, _stat())))).alias(f"tier{t}")
        for t, key in keys.items()
    ]
    return cells.groupBy("bid").agg(*maps, F.max(F.when(F.col("tier") == 4, _stat())).alias("tier4"))


def as_maps(cells: DataFrame) -> DataFrame:
    """Tier maps with the keys of the baseline document: "wday,hr", "class,hr" and "hr"."""
    hour = F.col("hr").cast("string")
    return _tier_maps(
        cells, {1: F.concat_ws(",", F.col("wday").cast("string"), hour), 2: F.concat_ws(",", F.col("wclass"), hour), 3: hour}
    )


def forecast_grid(cells: DataFrame) -> DataFrame:
    """bid, wday, hr -> tier, stat for all 168 cells of a building: the first tier that has the cell."""
    weekend = F.when(F.col("wclass") == "weekend", 24).otherwise(0)
    maps = _tier_maps(cells, {1: F.col("wday") * 24 + F.col("hr"), 2: weekend + F.col("hr"), 3: F.col("hr")})

    def resolve(slot: Column) -> Column:
        hour = slot % 24
        found = {
            1: F.try_element_at("tier1", slot),
            2: F.try_element_at("tier2", F.when(slot >= 5 * 24, hour + 24).otherwise(hour)),
            3: F.try_element_at("tier3", hour),
        }
        tier = F.coalesce(*[F.when(v.isNotNull(), F.lit(t)) for t, v in found.items()], F.lit(4))
        return F.struct(
            F.floor(slot / 24).cast("int").alias("wday"),
            hour.alias("hr"),
            tier.alias("tier"),
            F.coalesce(*found.values(), "tier4").alias("stat"),
        )

    # Resolved before the explode, so that the maps are not copied into every row.
    return maps.select("bid", F.inline(F.transform(F.sequence(F.lit(0), F.lit(167)), resolve)))


def forecast(cells: DataFrame, targets: DataFrame, *, tz: str = "UTC") -> DataFrame:
    """What is typical for ``bid`` at ``ts``, and the tier it comes from.

    The tiers are resolved on the baseline side, so the targets take one join instead of
    four. It is on (building, weekday, hour), which spreads one building's targets.
    """
    local = in_zone(F.col("ts"), tz)
    keyed = targets.withColumns({"_day": weekday(local), "_hour": F.hour(local)})
    grid = forecast_grid(cells).withColumnsRenamed({"wday": "_day", "hr": "_hour"})
    return keyed.join(grid, ["bid", "_day", "_hour"], "left").select(
        *targets.columns, "tier", "stat.mean", "stat.std", "stat.n"
    )
