"""The recurring jobs, put together from the operators.

campus_cycle     landed meter loads -> snapshot rows, header, histories, daily readings
weekly_report    daily readings -> day, building and campus figures, one report document
build_baselines  snapshots or readings -> baseline cells and document
dashboard        snapshot rows -> the tables of the campus page
building_summary exports of one building -> meter table and summary
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattfold.operators import baselines as base
from wattfold.operators import clean, dimensions, latest, rolling, rollups
from wattfold.sources import archives, exports, sinks

CYCLE_MINUTES = 15


@dataclass(frozen=True)
class Cycle:
    """Results of one cycle. ``snapshot``: one row per building; ``header``: one row."""

    snapshot: DataFrame
    header: DataFrame
    history: DataFrame


def extend_history(history: DataFrame, current: DataFrame, *, now: str, keep: int = rolling.HISTORY_ROWS) -> DataFrame:
    """bid, ts, seq, kw with the current loads added at ``now`` and cut to ``keep`` per building.

    ``seq`` counts cycles, so readings of equal time keep their order.
    """
    stamp = F.lit(now).cast(history.schema["ts"].dataType)
    nxt = history.select(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("seq")).scalar()
    fresh = current.filter(F.col("kw").isNotNull()).select("bid", stamp.alias("ts"), nxt.cast("bigint").alias("seq"), "kw")
    return rolling.last_n(history.select("bid", "ts", "seq", "kw").unionByName(fresh), order=["ts", "seq"], n=keep)


def judge_history(history: DataFrame) -> DataFrame:
    """Per building: last time, verdict on the last reading, forecast, sparkline.

    A history is short, and both rolling operators and the aggregate share the partitioning
    by building: one shuffle.
    """
    judged = rolling.wma_forecast(rolling.rolling_anomaly(history, hot_rows=None), hot_rows=None)
    at = F.struct("ts", "seq")
    points = F.array_sort(F.collect_list(F.struct("ts", "seq", "kw")))  # HISTORY_ROWS at most
    last = F.max_by(F.struct("ts", "kw", "anomaly_type", "avg_kw", "ratio", "predicted_kw"), at)
    return judged.groupBy("bid").agg(last.alias("last"), F.transform(points, lambda p: p["kw"]).alias("all_kw")).select(
        "bid",
        F.col("last.ts").alias("last_ts"),
        F.when(
            F.col("last.anomaly_type").isNotNull(),
            F.struct(
                F.col("last.anomaly_type").alias("type"),
                F.col("last.kw").alias("current"),
                F.col("last.avg_kw").alias("avg"),
                F.col("last.ratio").alias("ratio"),
            ),
        ).alias("anomaly"),
        F.col("last.predicted_kw").alias("predicted_kw"),
        F.when(F.size("all_kw") <= rolling.SPARK_ROWS, F.col("all_kw"))
        .otherwise(F.slice("all_kw", -rolling.SPARK_ROWS, rolling.SPARK_ROWS))
        .alias("sparkline"),
    )


def campus_cycle(registry: DataFrame, loads: DataFrame, history: DataFrame, *, now: str) -> Cycle:
    """One cycle. ``loads``: latest mac, meter, kw, ts. A building without a load has no
    verdict, but still a forecast from its old readings."""
    current = latest.resolve_buildings(registry, loads).withColumnRenamed("id", "bid")
    kept = extend_history(history, current, now=now)
    judged = judge_history(kept)
    snapshot = (
        latest.with_estimates(current.join(judged, "bid", "left"))
        .withColumn("anomaly", F.when(F.col("kw").isNotNull(), F.col("anomaly")))
        .withColumn("sparkline", F.coalesce("sparkline", F.array().cast("array<double>")))
        .select(
            "bid", "name", "kw", "status", F.col("ts").cast("string").alias("timestamp"), "mac", "meter", "predicted_kw",
            "anomaly", "sparkline", "est_daily_kwh", "est_daily_cost", "est_daily_co2_kg",
        )
    )
    return Cycle(snapshot, snapshot_header(snapshot, now=now), kept)


def snapshot_header(snapshot: DataFrame, *, now: str) -> DataFrame:
    total = latest.campus_total(snapshot)
    flagged = snapshot.select(F.count("anomaly").alias("n")).scalar()
    return total.select(
        F.lit(now).alias("generated_at"), F.lit(CYCLE_MINUTES).alias("update_interval_min"),
        "buildings_total", "buildings_online", "total_kw", "total_daily_kwh", "total_daily_cost", "total_daily_co2_kg",
        flagged.alias("anomaly_count"),
    )


def snapshot_document(snapshot: DataFrame, header: DataFrame) -> DataFrame:
    """Header plus the maps of anomalies and buildings, one row."""
    fields = [c for c in snapshot.columns if c != "bid"]
    anomalies = sinks.as_map(snapshot.filter(F.col("anomaly").isNotNull()), "bid", F.col("anomaly"), "m")
    entries = sinks.as_map(snapshot, "bid", F.struct(*fields), "m")
    return header.withColumn("anomalies", anomalies.scalar()).withColumn("buildings", entries.scalar())


def run_cycle(
    spark: SparkSession, registry: DataFrame, loads: DataFrame, out: str, *, cycle: int, now: str, document: bool = True
) -> None:
    """One cycle with its writes below ``out``. A repeated cycle writes the same again.

    Histories are versioned by cycle, as a table cannot be overwritten while it is read; a cycle goes on from the newest
    one before it, also when cycles were left out. Snapshots of more than a page go to a sharded document.
    """
    before = _latest_cycle(spark, f"{out}/history", cycle)
    if before is None:
        history = spark.createDataFrame([], "bid string, ts timestamp_ntz, seq bigint, kw double")
    else:
        history = spark.read.parquet(f"{out}/history/cycle={before}")
    result = campus_cycle(registry, loads, history, now=now)
    sinks.write_rows(result.history, f"{out}/history/cycle={cycle}")
    sinks.write_rows(result.snapshot, f"{out}/snapshot/cycle={cycle}")
    snapshot = spark.read.parquet(f"{out}/snapshot/cycle={cycle}")  # written once, read by the rest
    header = snapshot_header(snapshot, now=now)
    stamp = F.lit(now).cast("timestamp_ntz")
    day = now[:10]
    loads_now = snapshot.filter(F.col("kw").isNotNull()).select("bid", stamp.alias("ts"), "kw")
    sinks.write_rows(loads_now, f"{out}/readings/date={day}/cycle={cycle}")
    campus = header.select(stamp.alias("ts"), "total_kw", F.col("buildings_online").alias("online"))
    sinks.write_rows(campus, f"{out}/campus/date={day}/cycle={cycle}")
    days = F.array(*[F.lit(d) for d in sinks.stored_days(spark, f"{out}/campus")])
    sinks.write_document(spark.range(1).select(days.alias("days"), F.lit(now).alias("updated")), f"{out}/index")
    if document and snapshot.count() <= sinks.DOCUMENT_ENTRIES:
        sinks.write_document(snapshot_document(snapshot, header), f"{out}/campus_energy")
    elif document:
        fields = F.struct(*[c for c in snapshot.columns if c != "bid"])
        sinks.write_sharded(snapshot, f"{out}/campus_energy_shards", key="bid", value=fields, header=header)


def _latest_cycle(spark: SparkSession, path: str, cycle: int) -> int | None:
    """The newest finished cycle before ``cycle``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    finished = []
    for status in files.listStatus(at):
        folder = status.getPath()
        if folder.getName().startswith("cycle=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            finished.append(int(folder.getName().removeprefix("cycle=")))
    return max((c for c in finished if c < cycle), default=None)


# --- weekly report --------------------------------------------------------------------


@dataclass(frozen=True)
class WeeklyReport:
    days: DataFrame
    buildings: DataFrame
    campus: DataFrame


def weekly_report(
    campus: DataFrame, buildings: DataFrame, *, as_of: str, days: int = 7, names: DataFrame | None = None
) -> WeeklyReport:
    """``campus``: date, ts, total_kw, online; ``buildings``: date, ts, bid, kw; ``names``: bid, name."""
    end = F.lit(as_of).cast("date")
    span = (F.col("date") > F.date_sub(end, days)) & (F.col("date") <= end)
    weekly = rollups.building_weekly(buildings.filter(span))
    return WeeklyReport(
        rollups.daily_summary(campus.filter(span), date=F.col("date")).orderBy("date"),
        weekly if names is None else dimensions.with_names(weekly, names),
        rollups.campus_week(campus.filter(span)),
    )


def report_document(report: WeeklyReport, *, generated_at: str) -> DataFrame:
    """The report as one nested row, rankings by falling average."""
    day = F.struct(
        F.col("date").cast("string").alias("date"), "day", "avg_kw", "peak_kw", "peak_time", "min_kw",
        "readings_count", "avg_online", "est_kwh", "est_cost", "est_co2_kg",
    )
    daily = report.days.agg(F.array_sort(F.collect_list(day)).alias("v")).scalar()  # one entry per day
    stat = F.struct("avg_kw", "peak_kw", "min_kw", "readings", "est_weekly_kwh", "est_weekly_cost", "est_weekly_co2_kg")
    rankings = sinks.as_map(report.buildings, "bid", stat, "v", order=-F.col("avg_kw")).scalar()
    return report.campus.select(
        F.lit(generated_at).alias("generated_at"),
        F.struct(
            F.col("period_start").cast("string").alias("start"), F.col("period_end").cast("string").alias("end"),
            "days", "total_readings",
        ).alias("period"),
        F.struct(
            "avg_kw", "peak_kw", "min_kw", "total_kwh", "total_cost", "total_co2_kg", "total_co2_tons", "trees_equivalent"
        ).alias("campus_summary"),
        daily.alias("daily_breakdown"),
        rankings.alias("building_rankings"),
    )


# --- baselines ------------------------------------------------------------------------


def snapshot_samples(snapshots: DataFrame, *, compat: bool = False) -> DataFrame:
    """Samples from the sparklines of snapshots, 15 minutes apart. Points that overlapping
    snapshots repeat count once; with ``compat`` they count as often as they appear."""
    rows = archives.snapshot_buildings(snapshots).select("bid", "snap_ts", "sparkline")
    samples = rolling.expand_sparkline(rows)
    return samples if compat else base.dedupe_samples(samples)


def baseline_document(cells: DataFrame, *, generated_at: str, files: DataFrame | None = None) -> DataFrame:
    """Nested baselines with their metadata, one row."""
    maps = base.as_maps(cells)
    entries = sinks.as_map(maps, "bid", F.struct("tier1", "tier2", "tier3", "tier4"), "buildings")
    minimum = F.create_map(*[x for t in (1, 2, 3) for x in (F.lit(f"tier{t}"), F.lit(base.MIN_SAMPLES))])
    names = F.array().cast("array<string>")
    if files is not None:
        names = files.agg(F.sort_array(F.collect_set("file")).alias("f")).scalar()
    return entries.select(
        F.lit("Baselines per building; lookup order tier1 (weekday,hour), tier2 (class,hour), tier3 (hour), tier4. "
              "Weekday 0 is Monday.").alias("_doc"),
        F.lit(generated_at).alias("_generated_at"),
        names.alias("_source_files"),
        minimum.alias("_min_samples"),
        "buildings",
    )


# --- pages ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Dashboard:
    table: DataFrame
    categories: DataFrame
    efficiency: DataFrame
    top_load: DataFrame
    top_efficiency: DataFrame
    anomalies: DataFrame


def dashboard(snapshot: DataFrame, attributes: DataFrame) -> Dashboard:
    """Tables of the campus page. ``attributes``: bid, category, floors, year_built."""
    per_floor = rollups.efficiency(snapshot, attributes)
    online = snapshot.filter(F.col("kw").isNotNull())
    flagged = snapshot.filter(F.col("anomaly").isNotNull())
    return Dashboard(
        rollups.with_relative_band(snapshot),
        rollups.category_rollup(snapshot, attributes),
        per_floor,
        rollups.top_k(online, by="kw", tie="bid"),
        rollups.top_k(per_floor, by="kw_per_floor", tie="bid"),
        flagged.select("bid", "name", "anomaly.*", rolling.deviation_percent("anomaly.ratio").alias("deviation_pct")),
    )


@dataclass(frozen=True)
class Interior:
    """``meters``: one row per meter; ``summary`` and ``peak``: one row."""

    meters: DataFrame
    summary: DataFrame
    peak: DataFrame


STAT = ("current", "min", "max", "avg", "count", "peak_time")
EXPORT_ORDER = ["ts", "line"]


def _today_stats(today: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Per meter the statistics of several measures, packed as stats_today."""
    parts = [
        rollups.series_stats(today, by=["meter"], value=col, order=EXPORT_ORDER).select("meter", F.struct(*STAT).alias(name))
        for name, col in columns.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "meter", "full")
    return out.select("meter", F.struct(*columns).alias("stats_today"))


def _series(recent: DataFrame, value: str, name: str) -> DataFrame:
    """Per meter the last 96 rows as (t, v) pairs in time order, nulls dropped after the cut."""
    tail = rolling.last_n(recent, by=["meter"], order=EXPORT_ORDER, value=value)
    points = F.array_sort(F.collect_list(F.struct(*EXPORT_ORDER, F.col("local_time").alias("t"), F.col(value).alias("v"))))
    pairs = F.transform(points, lambda p: F.struct(p["t"].alias("t"), p["v"].alias("v")))
    return tail.groupBy("meter").agg(pairs.alias(name))


def _latest_row(recent: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    rows = recent.select("meter", *EXPORT_ORDER, "local_time", *measures)
    return latest.latest(rows, by=["meter"], order=EXPORT_ORDER)


def building_summary(readings: DataFrame, meters: DataFrame, *, as_of: str, hours: float = 24) -> Interior:
    """Meters of one building: ``readings`` as read_power gives them; ``meters``: meter, ord, name, voltage."""
    recent = clean.lookback(readings, as_of=as_of, hours=hours)
    today = clean.on_day(recent, as_of=as_of[:10])
    now = _latest_row(recent, exports.POWER_MEASURES)
    row = F.struct(F.col("local_time").alias("timestamp"), *exports.POWER_MEASURES).alias("latest")
    parts = (
        latest.meter_status(meters, now)
        .drop("kw")
        .join(now.select("meter", row), "meter", "left")
        .join(_today_stats(today, {"kw": "kw", "power_factor": "power_factor", "current": "current_avg"}), "meter", "left")
        .join(_series(recent, "kw", "timeseries_kw"), "meter", "left")
    )
    ids = [r["meter"] for r in meters.select("meter").orderBy("ord").collect()]  # the building's few meters
    stats = rollups.series_stats(today, by=["meter"], order=EXPORT_ORDER).join(meters.select("meter", "ord"), "meter")
    return Interior(parts, rollups.interior_summary(now, ids), rollups.cross_meter_peak(stats))


def water_summary(readings: DataFrame, *, as_of: str, hours: float = 24) -> DataFrame:
    """Water and steam meters: latest row, today's rates, the last 96 flow values."""
    recent = clean.lookback(readings, as_of=as_of, hours=hours)
    today = clean.on_day(recent, as_of=as_of[:10])
    row = F.struct(F.col("local_time").alias("timestamp"), *exports.WATER_MEASURES).alias("latest")
    return (
        _latest_row(recent, exports.WATER_MEASURES)
        .select("meter", F.lit("online").alias("status"), row)
        .join(_today_stats(today, {"water_rate": "water1_rate_cfm", "steam_rate": "steam_rate_gpm"}), "meter", "left")
        .join(_series(recent, "water1_rate_cfm", "timeseries_water"), "meter", "left")
    )


def interior_document(
    interior: Interior, *, generated_at: str, building: dict[str, str], water: DataFrame | None = None
) -> DataFrame:
    """Meters, water and summary of one building as one nested row."""
    fields = [c for c in interior.meters.columns if c not in ("meter", "ord")]
    meters = sinks.as_map(interior.meters, "meter", F.struct(*fields), "m", order=F.col("ord"))
    about = F.create_map(*[F.lit(x) for pair in building.items() for x in pair])
    flow, flows = F.struct(F.lit("offline").alias("status")), []
    if water is not None:  # the first meter in the usual place, all of them beside it
        row = F.struct(*[c for c in water.columns if c != "meter"])
        flow = water.agg(F.min_by(row, "meter")).scalar()
        flows = [sinks.as_map(water, "meter", row, "m").scalar().alias("water_meters")]
    return interior.summary.select(
        about.alias("building"),
        F.lit(generated_at).alias("generated_at"),
        F.lit(CYCLE_MINUTES).alias("update_interval_min"),
        meters.scalar().alias("meters"),
        flow.alias("water"),
        *flows,
        F.struct(*interior.summary.columns).alias("summary"),
    )
