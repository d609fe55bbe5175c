"""Registered queries: each operator on the given tables, whole tables throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattfold.functions import energy, names
from wattfold.functions.clock import clock_label
from wattfold.operators import baselines as base
from wattfold.session import scratch_path
from wattfold.operators import chat, clean, dimensions, hotkeys, latest, rolling, rollups, votes
from wattfold.sources import archives, sinks, tables
from wattfold.streaming import readings as streams
from wattfold.streaming import votes as vote_streams
from wattfold.sources.exports import KW_HEADERS, MAIN_METER_HEADERS, PANEL_HEADERS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the queries.
DAY = "2024-01-15"
NOON = "2024-01-15 12:00:00"
MONTH_END = "2024-01-31 00:00:00"
SUNDAY = "1998-10-04"
#: From when on registered buildings are expected to report, and the silence that is told.
REGISTERED, SILENT_HOURS = "2023-12-31 12:00:00", 48
#: Rows of a key from which on the cut plans work in segments, and the history that a stream holds.
CUT_ROWS, STREAM_KEEP = 40, 24
#: Days read from the daily store, and entries per shard of a document.
RANGE, SHARD_ENTRIES = ("2024-01-14", "2024-01-20"), 40
#: Parts of the time in the order in which they land: not the order of time.
QUARTERS, HALVES = (1, 0, 3, 2), (1, 0)
PART_NAMES = {
    "red widget": "Red W",
    "blue bolt": "Bolt B",
    "hot gear": "Gear H",
    "small": "Small",
    "old bolt Hall": "Old Bolt",
}
FLOOR_SHARES = (
    ("B1", "click", 0.55), ("B1", "purchase", 0.16), ("L1", "click", 0.45), ("L1", "purchase", 0.31),
    ("L2", "purchase", 0.35), ("L3", "purchase", 0.18), ("SRV", "view", 1.0),
)


def query(fn: Query) -> Query:
    """Registers ``fn``; dates leave as ISO text, which every client shows alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        dates = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType)]
        return df.withColumns({d: F.col(d).cast("string") for d in dates}) if dates else df

    run.__name__ = fn.__name__
    QUERIES[fn.__name__] = run
    return fn


def _by_type(**values: str | None) -> Column:
    """Text per event type; types not listed get the value itself as text."""
    kind = F.col("meter")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, value in values.items():
        out = out.when(kind == name, F.lit(value).cast("string"))
    return out.otherwise(F.col("kw").cast("string"))


def _text(column: Column) -> Column:
    return column.cast("string")


def _current(spark: SparkSession, sf: str) -> DataFrame:
    return latest.latest(tables.readings(spark, sf), by=["bid"])


def _attributes(spark: SparkSession, sf: str) -> DataFrame:
    part = tables.table(spark, sf, "part")
    return part.select(
        F.col("p_partkey").alias("bid"),
        F.when(F.col("p_size") <= 40, F.col("p_size")).alias("floors"),
        F.when(F.col("p_size") > 5, F.col("p_size") + 1950).alias("year_built"),
    )


# --- scans, cleaning, latest ----------------------------------------------------------


@query
def html_payload_quarantine(spark, sf):
    pages = tables.table(spark, sf, "pages").select(F.concat(F.lit("page-"), "page_id").alias("payload"), F.col("html").alias("value"))
    texts = tables.table(spark, sf, "documents").select(F.concat(F.lit("text-"), "doc_id").alias("payload"), F.col("text").alias("value"))
    return clean.sniff_html(pages.unionByName(texts), payload="value").select("payload", "rejected")


@query
def day_index(spark, sf):
    return rollups.day_index(tables.readings(spark, sf))


@query
def meter_normalize(spark, sf):
    raw = tables.readings(spark, sf).select(
        "seq",
        F.when(F.col("meter") == "error", "3").otherwise(F.col("meter")).alias("meter"),
        F.when(F.col("meter") == "error", _text(F.col("kw"))).alias(MAIN_METER_HEADERS["kw"]),
        F.when(F.col("meter") != "error", _text(F.col("kw"))).alias(PANEL_HEADERS["kw"]),
        _text(F.col("kw") / 8.0).alias("Frequency (Hz)"),
        _text(F.col("kw") * 1e6).alias(PANEL_HEADERS["thd_v1"]),
    )
    measures = ["kw", "frequency", "thd_v1"]
    dialects = [(F.col("meter") == "3", MAIN_METER_HEADERS), (F.lit(True), PANEL_HEADERS)]
    return clean.normalize(raw, dialects, ["seq", "meter"], measures)


@query
def drop_error_rows(spark, sf):
    flag = _by_type(error="5", signup="x", purchase=None, view="0", click="0.0")
    rows = tables.readings(spark, sf).withColumn("error", flag)
    return clean.require(clean.drop_error_rows(rows)).select("bid", "ts", "kw", "seq")


@query
def safe_float_clean(spark, sf):
    rows = tables.readings(spark, sf)
    text = (
        F.when(F.col("meter") == "error", "n/a")
        .when(F.col("meter") == "click", "")
        .when(F.col("meter") == "purchase", _text(F.col("kw") * 1e7))
        .otherwise(_text(F.col("kw") / 7.0))
    )
    return clean.safe_float(rows.select("seq", text.alias("kw")), ["kw"])


@query
def any_measure_present(spark, sf):
    rows = tables.readings(spark, sf).select(
        "seq",
        F.when(F.col("meter") == "view", F.col("kw")).alias("water_rate"),
        F.when(F.col("meter") == "purchase", F.col("kw")).alias("steam_rate"),
    )
    return clean.any_measure_present(rows, ["water_rate", "steam_rate"])


@query
def kw_resolve_priority(spark, sf):
    raw = tables.readings(spark, sf).select(
        "seq",
        _by_type(error="60000", signup="", view="-3").alias("kW total (kW)"),
        F.when(F.col("meter").isin("view", "signup"), _text(F.col("kw") / 3.0)).alias("Active Power Total (kW)"),
        F.lit("7").alias("Total kWh"),
        F.when(F.col("kw") >= 100, _text(F.col("kw") * 2.0)).alias("Spare kW"),
    )
    return clean.resolve_kw(raw, candidates=KW_HEADERS).select("seq", "kw")


@query
def daily_estimates(spark, sf):
    rows = tables.readings(spark, sf).withColumn("kw", F.when(F.col("meter") != "error", F.col("kw")))
    return latest.with_estimates(rows).select("seq", "kw", "status", "est_daily_kwh", "est_daily_cost", "est_daily_co2_kg")


@query
def meter_status(spark, sf):
    kinds = F.array(*[F.lit(m) for m in tables.METERS])
    meters = tables.named_buildings(spark, sf).select("bid", F.explode(kinds).alias("meter"))
    now = latest.latest(tables.readings(spark, sf), by=["bid", "meter"])
    return latest.meter_status(meters, now, on=["bid", "meter"])


@query
def today_filter(spark, sf):
    return clean.on_day(tables.readings(spark, sf), as_of=DAY).select("bid", "ts", "kw", "seq")


@query
def lookback_filter(spark, sf):
    return clean.lookback(tables.readings(spark, sf), as_of=NOON, hours=48).select("bid", "ts", "kw", "seq")


@query
def latest_per_meter(spark, sf):
    return latest.latest(tables.readings(spark, sf), by=["bid", "meter"])


def _meter_loads(spark, sf):
    """Latest row per building and meter, without a load where it is below 20."""
    now = latest.latest(tables.readings(spark, sf), by=["bid", "meter"])
    return now.select(F.col("bid").alias("mac"), "meter", F.when(F.col("kw") >= 20, F.col("kw")).alias("kw"), "ts")


def _registry(spark, sf, *meters: str, ordinal: int = 1, mark: str = "") -> DataFrame:
    return tables.buildings(spark, sf).select(
        F.col("bid").alias("id"),
        F.lit(ordinal).alias("ordinal"),
        F.concat("name", F.lit(mark)).alias("name"),
        F.col("bid").alias("mac"),
        F.array(*[F.lit(m) for m in meters]).alias("meters"),
    )


@query
def meter_fallback(spark, sf):
    return latest.resolve_buildings(_registry(spark, sf, *tables.METERS), _meter_loads(spark, sf))


@query
def alias_fallback(spark, sf):
    registry = _registry(spark, sf, "error", mark=" (Legacy)").unionByName(
        _registry(spark, sf, "purchase", "view", ordinal=2)
    )
    return latest.resolve_buildings(registry, _meter_loads(spark, sf))


@query
def offline_anti(spark, sf):
    return latest.offline(tables.named_buildings(spark, sf), _current(spark, sf), on="bid").select("bid", "name")


@query
def online_semi(spark, sf):
    return latest.online(tables.named_buildings(spark, sf), _current(spark, sf), on="bid").select("bid", "name")


@query
def silent_buildings(spark, sf):
    return latest.silent_since(tables.readings(spark, sf), by=["bid"], as_of=MONTH_END, hours=24)


@query
def registry_left_live(spark, sf):
    return dimensions.registry_left_live(tables.named_buildings(spark, sf), _current(spark, sf)).select("bid", "name", "kw", "ts")


# --- ordered operators ----------------------------------------------------------------


@query
def anomaly_rolling(spark, sf):
    out = rolling.rolling_anomaly(tables.readings(spark, sf))
    return out.withColumn("deviation_pct", rolling.deviation_percent("ratio")).drop("meter")


@query
def anomaly_time_range(spark, sf):
    """Against the last 60 hours instead of the last rows."""
    out = rolling.rolling_anomaly(tables.readings(spark, sf), hours=60)
    return out.select("bid", "seq", "anomaly_type", "avg_kw", "ratio")


@query
def wma_forecast(spark, sf):
    return rolling.wma_forecast(tables.readings(spark, sf)).select("bid", "seq", "kw", "predicted_kw")


@query
def history_96(spark, sf):
    return rolling.last_n(tables.readings(spark, sf)).select("bid", "ts", "kw", "seq")


@query
def series_last_96(spark, sf):
    rows = tables.readings(spark, sf).withColumn("kw", F.when(F.col("meter") != "error", F.col("kw")))
    return rolling.last_n(rows, by=["bid"], value="kw").select("bid", "ts", "kw", "seq")


@query
def sparkline_24(spark, sf):
    lines = rolling.sparkline(tables.readings(spark, sf))
    return lines.select("bid", F.posexplode("sparkline").alias("i", "kw"))


@query
def sparkline_expand(spark, sf):
    lines = rolling.sparkline(tables.readings(spark, sf))
    snaps = lines.withColumn("snap_ts", F.lit(MONTH_END).cast("timestamp_ntz"))
    return rolling.expand_sparkline(snaps)


@query
def clock_fold(spark, sf):
    return rolling.clock_fold(tables.readings(spark, sf))


@query
def snapshot_asof(spark, sf):
    return rolling.snapshot_asof(tables.readings(spark, sf), t=NOON).select("bid", "ts", "kw", "seq")


@query
def last_96_labels(spark, sf):
    return rolling.last_labels(tables.readings(spark, sf))


@query
def rank_by_kw(spark, sf):
    rows = dimensions.registry_left_live(tables.named_buildings(spark, sf), _current(spark, sf)).select("bid", "name", "kw")
    return hotkeys.global_rank(rows, order=[F.desc(F.coalesce("kw", F.lit(0.0))), F.col("bid")])


@query
def positional_combine(spark, sf):
    return rollups.combine(tables.readings(spark, sf), positional=True)


@query
def bucket_combine(spark, sf):
    return rollups.combine(tables.readings(spark, sf))


# --- rollups --------------------------------------------------------------------------


@query
def series_stats(spark, sf):
    return rollups.series_stats(tables.readings(spark, sf), by=["bid"])


@query
def shipment_stats(spark, sf):
    rows = tables.shipments(spark, sf)
    return rows.groupBy("bid").agg(
        F.min("kw").alias("min"), F.max("kw").alias("max"), F.count("kw").alias("count"), F.max("ts").alias("last_ts")
    )


@query
def campus_total(spark, sf):
    return latest.home_equivalents(latest.campus_total(_current(spark, sf)))


@query
def meter_pivot_summary(spark, sf):
    return rollups.interior_summary(latest.latest(tables.readings(spark, sf), by=["meter"]), tables.METERS)


@query
def anomaly_count(spark, sf):
    flagged = rolling.rolling_anomaly(tables.readings(spark, sf))
    now = latest.latest(flagged.select("bid", "ts", "seq", "anomaly_type"), by=["bid"])
    return now.agg(
        F.count("anomaly_type").alias("anomaly_count"),
        F.count(F.when(F.col("anomaly_type") == "high", 1)).alias("high"),
        F.count(F.when(F.col("anomaly_type") == "low", 1)).alias("low"),
    )


@query
def anomaly_map(spark, sf):
    """The anomalies a snapshot shows: buildings whose latest reading is flagged."""
    flagged = rolling.rolling_anomaly(tables.readings(spark, sf))
    now = latest.latest(flagged.select("bid", "ts", "seq", "kw", "anomaly_type", "avg_kw", "ratio"), by=["bid"])
    return now.filter(F.col("anomaly_type").isNotNull()).select(
        "bid", F.col("anomaly_type").alias("type"), F.col("kw").alias("current"), F.col("avg_kw").alias("avg"), "ratio"
    )


@query
def category_rollup(spark, sf):
    known = tables.buildings(spark, sf).filter("segment <> 'MACHINERY'")
    return rollups.category_rollup(_current(spark, sf), known)


@query
def kw_per_floor(spark, sf):
    return rollups.efficiency(_current(spark, sf), _attributes(spark, sf)).select(
        "bid", "kw", "floors", "kw_per_floor", "efficiency_band"
    )


@query
def avg_efficiency(spark, sf):
    return rollups.avg_efficiency(rollups.efficiency(_current(spark, sf), _attributes(spark, sf)))


@query
def age_vs_energy(spark, sf):
    rows = rollups.age_vs_energy(rollups.efficiency(_current(spark, sf), _attributes(spark, sf)))
    return rows.select("bid", "year_built", "kw", "floors", "kw_per_floor")


@query
def load_band(spark, sf):
    return tables.readings(spark, sf).select(
        "seq", energy.load_band(F.col("kw")).alias("load_band"), energy.legend_band(F.col("kw")).alias("legend_band")
    )


@query
def relative_band(spark, sf):
    return rollups.with_relative_band(_current(spark, sf)).select("bid", "kw", "band")


@query
def pf_normalize(spark, sf):
    return tables.readings(spark, sf).select("seq", energy.power_factor(F.col("kw")).alias("pf"))


@query
def load_timeline(spark, sf):
    return rollups.load_timeline(tables.readings(spark, sf))


@query
def load_timeline_folded(spark, sf):
    return rollups.load_timeline(tables.readings(spark, sf), clock_label_fold=True)


def _cycles(spark, sf):
    """Each event as one campus cycle; purchases count as cycles without load."""
    return tables.table(spark, sf, "events").select(
        "ts",
        F.when(F.col("event_type") != "purchase", F.col("value")).otherwise(0.0).alias("total_kw"),
        F.from_json("props", "k INT")["k"].alias("online"),
        F.col("event_id").alias("seq"),
    )


@query
def daily_summary(spark, sf):
    return rollups.daily_summary(_cycles(spark, sf), seq=["seq"])


@query
def daily_summary_orders(spark, sf):
    return rollups.daily_summary(tables.campus(spark, sf), seq=["seq"])


@query
def building_weekly(spark, sf):
    rows = tables.readings(spark, sf).withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    out = rollups.building_weekly(rows, by=["week", "bid"])
    return dimensions.with_names(out, tables.named_buildings(spark, sf))


@query
def campus_week(spark, sf):
    week = F.to_date(F.date_trunc("week", "ts")).alias("week")
    return rollups.campus_week(tables.campus(spark, sf), by=[week])


@query
def campus_week_asof(spark, sf):
    return rollups.campus_week(tables.campus(spark, sf), as_of=SUNDAY)


@query
def report_week_offset(spark, sf):
    week = F.to_date(F.date_trunc("week", "ts")).alias("week")
    weekly = rollups.campus_week(tables.campus(spark, sf), by=[week])
    reports = weekly.withColumn("report_date", F.date_add("week", 6))
    return dimensions.report_for(reports, as_of=SUNDAY, week_offset=-2).select(
        "report_date", "avg_kw", "total_kwh", "total_readings"
    )


@query
def week_over_week(spark, sf):
    return rollups.week_over_week(tables.campus(spark, sf))


@query
def cross_meter_peak(spark, sf):
    order = F.array_position(F.array(*[F.lit(m) for m in tables.METERS]), F.col("meter"))
    stats = rollups.series_stats(tables.readings(spark, sf), by=["meter"]).withColumn("ord", order)
    return rollups.cross_meter_peak(stats)


@query
def top10_kw(spark, sf):
    rows = latest.with_estimates(_current(spark, sf))
    return rollups.top_k(rows, by="kw", tie="bid").select("bid", "kw", "est_daily_cost")


@query
def top10_efficiency(spark, sf):
    rows = rollups.efficiency(_current(spark, sf), _attributes(spark, sf))
    return rollups.top_k(rows, by="kw_per_floor", tie="bid").select("bid", "kw_per_floor")


@query
def union_all_readings(spark, sf):
    both = dimensions.union_readings(tables.readings(spark, sf).drop("meter"), tables.shipments(spark, sf))
    return both.groupBy("bid").agg(
        F.count(F.lit(1)).alias("rows"), F.count("seq").alias("event_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query
def union_distinct_labels(spark, sf):
    parts = [t.select(clock_label(F.col("ts")).alias("label")) for t in (tables.readings(spark, sf), tables.campus(spark, sf))]
    return dimensions.union_labels(*parts)


# --- baselines ------------------------------------------------------------------------


def _cells(spark, sf):
    return base.baselines(tables.readings(spark, sf))


def _tier(tier: int, *cols: str) -> Query:
    def run(spark, sf):
        return _cells(spark, sf).filter(F.col("tier") == tier).select("bid", *cols, "mean", "std", "n")

    run.__name__ = f"baseline_tier{tier}"
    return run


for _number, _cols in {1: ("wday", "hr"), 2: ("wclass", "hr"), 3: ("hr",), 4: ()}.items():
    query(_tier(_number, *_cols))


@query
def baseline_grouping_sets(spark, sf):
    return _cells(spark, sf)


@query
def baseline_shipments(spark, sf):
    return base.baselines(tables.shipments(spark, sf))


@query
def baseline_coverage(spark, sf):
    return base.coverage(_cells(spark, sf))


@query
def coverage_top5(spark, sf):
    return rollups.top_k(base.coverage(_cells(spark, sf)), by="samples", tie="bid", k=5).select("bid", "samples")


@query
def forecast_lookup(spark, sf):
    targets = tables.readings(spark, sf).select("seq", "bid", (F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("ts"))
    return base.forecast(_cells(spark, sf), targets)


# --- dimensions -----------------------------------------------------------------------


@query
def short_name(spark, sf):
    name = F.concat("p_name", F.when(F.col("p_size") > 25, " Hall").otherwise(" Center"))
    return tables.table(spark, sf, "part").select(
        "p_partkey",
        names.short_name(name, PART_NAMES).alias("short_name"),
        names.simple_name(name, PART_NAMES).alias("simple_name"),
    )


@query
def nice_name(spark, sf):
    identifier = F.replace("p_name", F.lit(" "), F.lit("_"))
    return tables.table(spark, sf, "part").select(
        "p_partkey", names.nice_name(identifier, {"red_widget": "The Red Widget"}).alias("nice_name")
    )


@query
def floor_allocation(spark, sf):
    rows = F.array(*[F.struct(F.lit(f).alias("floor"), F.lit(m).alias("meter"), F.lit(s).alias("share")) for f, m, s in FLOOR_SHARES])
    shares = spark.range(1).select(F.inline(rows))
    daily = tables.readings(spark, sf).withColumn("date", F.to_date("ts"))
    return dimensions.floor_allocation(daily, shares, by=("date",))


@query
def shared_meter_check(spark, sf):
    registry = tables.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("mac"), F.array("c_mktsegment").alias("meters")
    )
    return dimensions.shared_meters(registry)


# --- votes ----------------------------------------------------------------------------


def _tally(spark, sf):
    slot = F.window("ts", "2 hours")["start"].alias("slot")
    return votes.vote_tally(tables.votes(spark, sf), by=[slot, "building"])


@query
def vote_tally(spark, sf):
    return _tally(spark, sf)


@query
def vote_tally_asof(spark, sf):
    return votes.vote_tally(tables.votes(spark, sf), as_of=NOON)


@query
def vote_overview(spark, sf):
    return votes.vote_overview(_tally(spark, sf), by=["slot"])


@query
def vote_shares(spark, sf):
    return votes.vote_shares(votes.vote_tally(tables.votes(spark, sf))).select("building", "total", "hot_pct", "ok_pct", "cold_pct")


@query
def recent_feed(spark, sf):
    cast = tables.votes(spark, sf)
    return votes.recent_votes(cast, votes.vote_tally(cast)).select("building", "ts", "vote", "seq")


@query
def vote_cooldown(spark, sf):
    cast = tables.votes(spark, sf).select("voter", "ts", "seq")
    return votes.cooldown(cast, minutes=600).select("voter", "seq", "accepted")


# --- chat -----------------------------------------------------------------------------


def _replies(spark, sf):
    """Conversation turns with action markers made from their numbers and the nation names."""
    nation = tables.table(spark, sf, "nation")
    turns = tables.turns(spark, sf)
    joined = turns.join(nation, F.pmod("conv_id", F.lit(25)) == nation.n_nationkey, "left")
    marks = F.concat(
        F.col("text"),
        F.lit("\n<<ZOOM: "), F.col("n_name"), F.lit(" >>"),
        F.when(F.col("turn") == 1, "\n<filter:ASIA>>").when(F.col("turn") == 2, "<<FILTER:Nowhere>>").otherwise(" <<TREND>> "),
        F.when(F.col("role") == "user", "<<Reset>>").otherwise(""),
    )
    return joined.select("conv_id", "turn", "role", marks.alias("text"))


@query
def chat_lang(spark, sf):
    turns = tables.turns(spark, sf)
    text = F.when(F.col("role") == "system", F.concat("text", F.lit(" 안녕"))).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", text.alias("text"), F.when(F.col("turn") > 2, "fr").alias("hint"))
    return chat.chat_lang(rows, hint="hint").select("conv_id", "turn", "lang")


@query
def chat_actions(spark, sf):
    return chat.chat_actions(_replies(spark, sf).drop("role"))


@query
def chat_clean(spark, sf):
    return chat.chat_clean(_replies(spark, sf)).select("conv_id", "turn", "answer")


@query
def action_whitelist(spark, sf):
    nation, region = tables.table(spark, sf, "nation"), tables.table(spark, sf, "region")
    zoom = nation.filter("n_regionkey <> 1").select(F.lit("zoom").alias("type"), F.col("n_name").alias("arg"))
    filters = region.select(F.lit("filter").alias("type"), F.col("r_name").alias("arg"))
    return chat.whitelist(chat.chat_actions(_replies(spark, sf).drop("role")), zoom.unionByName(filters))


@query
def chat_history_clip(spark, sf):
    return chat.chat_history(tables.turns(spark, sf)).select("conv_id", "turn", "role", "text")


@query
def chat_clip(spark, sf):
    rows = tables.turns(spark, sf).select(
        "conv_id", "turn",
        F.when(F.col("role") != "system", F.repeat("text", 3)).alias("question"),
        F.repeat("text", 6).alias("context"),
    )
    return chat.chat_clip(rows)


# --- rankings -------------------------------------------------------------------------


@query
def buildings_by_votes(spark, sf):
    return votes.rank_by_votes(votes.vote_tally(tables.votes(spark, sf))).select("rank", "building", "total", "status")


@query
def rank_by_average(spark, sf):
    rows = rollups.building_weekly(tables.readings(spark, sf)).select("bid", "avg_kw", "est_weekly_kwh")
    return hotkeys.global_rank(rows, order=[F.desc("avg_kw"), F.col("bid")])


@query
def day_order(spark, sf):
    days = rollups.daily_summary(_cycles(spark, sf), seq=["seq"]).select("date", "avg_kw", "est_kwh")
    return hotkeys.global_rank(days, order=[F.col("date")], name="position")


# --- stores, written and read back ----------------------------------------------------


@query
def daily_store(spark, sf):
    """The daily store written, one of its days written again with doubled loads, a range of days read."""
    path = scratch_path(spark, "days")
    rows = tables.readings(spark, sf)
    sinks.write_days(rows, path)
    again = rows.filter(F.to_date("ts") == F.lit(DAY).cast("date")).withColumn("kw", F.col("kw") * 2)
    sinks.write_days(again, path)
    return sinks.read_days(spark, path, start=RANGE[0], end=RANGE[1]).select("date", "bid", "seq", "kw")


def _snapshot_files(spark, sf):
    """A snapshot document per six hours of readings, in a file of its own; some cut short, some without buildings or time."""
    rows = tables.readings(spark, sf)
    slot = F.window("ts", "6 hours")["start"]
    hours = latest.latest(rows.withColumn("hour", slot), by=["hour", "bid"])
    building = F.struct(F.col("bid").cast("string").alias("k"), F.struct("kw").alias("v"))
    docs = hours.filter("hour is not null").groupBy("hour").agg(F.map_from_entries(F.array_sort(F.collect_list(building))).alias("buildings"))
    number = F.hour("hour") + 24 * F.day("hour")
    docs = docs.withColumns({
        "generated_at": F.when(number % 11 != 0, F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        "buildings": F.when(number % 7 != 0, F.col("buildings")),
    })
    text = F.to_json(F.struct("generated_at", "buildings"))
    cut = F.when(F.col("number") % 5 == 0, F.expr("substr(value, 1, length(value) div 2)")).otherwise(F.col("value"))
    named = docs.select(F.date_format("hour", "yyyy-MM-dd-HH").alias("snap"), number.alias("number"), text.alias("value"))
    path = scratch_path(spark, "snapshots")
    named.withColumn("value", cut).select("snap", "value").write.partitionBy("snap").text(path)
    return path


@query
def snapshot_quarantine(spark, sf):
    """What became of every snapshot file, and how many buildings the good ones hold."""
    docs = archives.checked_snapshots(spark, _snapshot_files(spark, sf), glob=None)
    snap = F.regexp_extract("path", "snap=([^/]+)", 1)
    return docs.select(snap.alias("snap"), "problem", F.when(F.col("problem").isNull(), F.size("buildings")).alias("buildings"))


@query
def sharded_document(spark, sf):
    """Latest loads as a document of many shards, written and read back."""
    path = scratch_path(spark, "document")
    rows = _current(spark, sf).select(F.col("bid").cast("string").alias("bid"), "kw", "meter")
    sinks.write_sharded(rows, path, key="bid", value=F.struct("kw", "meter"), entries=SHARD_ENTRIES)
    return sinks.read_sharded(spark, path, "STRUCT<kw DOUBLE, meter STRING>").select("bid", "v.*")


# --- hot keys: the cut plans, on keys and times with nulls ------------------------------


def _gappy(spark, sf):
    """Readings of which some have no building and some no time, and a building with a burst in one second."""
    return tables.readings(spark, sf).select(
        F.when(F.col("bid") != 3, F.col("bid")).alias("bid"),
        F.when(F.col("bid") == 5, F.date_trunc("day", "ts")).when(F.col("seq") % 50 != 0, F.col("ts")).alias("ts"),
        "kw", "meter", "seq",
    )


@query
def anomaly_hot_cut(spark, sf):
    rows = rolling.rolling_anomaly(_gappy(spark, sf), hot_rows=CUT_ROWS)
    return rolling.wma_forecast(rows, hot_rows=CUT_ROWS).select("bid", "seq", "anomaly_type", "avg_kw", "ratio", "predicted_kw")


@query
def position_hot_cut(spark, sf):
    rows = _gappy(spark, sf).select("bid", "ts", "seq")
    return hotkeys.row_position(rows, by=["bid"], order=["ts", "seq"], hot_rows=CUT_ROWS).select("bid", "seq", "position")


@query
def vote_cooldown_cut(spark, sf):
    return votes.cooldown(tables.votes(spark, sf), minutes=600, hot_rows=CUT_ROWS).select("voter", "seq", "accepted")


# --- streams, run over all that has landed --------------------------------------------


def _event_stream(spark, sf):
    schema = tables.table(spark, sf, "events").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/events.parquet")  # a file, or a directory of part files
    parts = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    files = streams.read_stream(spark, f"{sf}/events.parquet", schema) if parts else streams.read_stream(spark, sf, schema, glob="events.parquet")
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def _landed(spark, sf, landing=HALVES):
    """The events as a stream of parts that land out of order, one per micro-batch, and how late that makes their rows."""
    events = tables.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    width = ((last or 0) - (first or 0)) // len(landing) + 1
    chunk = F.coalesce(F.floor((F.unix_micros("ts") - (first or 0)) / width), F.lit(0))
    path, files = scratch_path(spark, "landed"), max(1, events.rdd.getNumPartitions())
    for at in landing:
        events.where(chunk == at).repartition(files).write.mode("append").parquet(path)
    return streams.read_stream(spark, path, events.schema, files_per_trigger=files), f"{2 * width // 1_000_000 + 1} seconds"


def _landed_readings(spark, sf, landing=HALVES):
    stream, lateness = _landed(spark, sf, landing)
    rows = stream.select(F.col("user_id").alias("bid"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("kw"))
    return rows, lateness


@query
def stream_verdicts(spark, sf):
    rows, lateness = _landed_readings(spark, sf, QUARTERS)
    out = streams.replay_verdicts(rows, lateness=lateness)
    return out.filter(F.col("kw").isNotNull()).select("bid", "seq", "kw", "anomaly_type", "avg_kw", "ratio", "predicted_kw")


@query
def stream_silent(spark, sf):
    """Every silence of two days up to the end of the month, of registered buildings that never report as well."""
    rows, lateness = _landed_readings(spark, sf)
    registry = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("bid"), F.lit(REGISTERED).alias("ts"))
    out = streams.replay_verdicts(rows, lateness=lateness, until=MONTH_END, offline_hours=SILENT_HOURS, registry=registry)
    return out.filter("kw is null").select("bid", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("offline_at"), "seq", "predicted_kw")


@query
def stream_history(spark, sf):
    """The last readings per building, read from the state of the stream."""
    rows, lateness = _landed_readings(spark, sf)
    marks = scratch_path(spark, "history-marks")
    streams.replay_verdicts(rows, lateness=lateness, keep=STREAM_KEEP, marks=marks)
    return streams.held_history(spark, marks).select("bid", "seq", "kw")


@query
def stream_day_totals(spark, sf):
    parts = streams.replay_parts(_landed_readings(spark, sf)[0], streams.day_parts).read()
    return streams.day_totals(parts).withColumn("day_start", F.date_format("day_start", "yyyy-MM-dd"))


@query
def stream_vote_tally(spark, sf):
    parts = streams.replay_parts(tables.as_votes(_landed(spark, sf)[0]), vote_streams.slot_parts).read()
    return vote_streams.slot_tally(parts).withColumn("slot", F.date_format("slot", "yyyy-MM-dd HH:mm"))


@query
def stream_cooldown(spark, sf):
    stream, lateness = _landed(spark, sf)
    out = vote_streams.replay_cooldown(tables.as_votes(stream), minutes=600, lateness=lateness)
    return out.select("voter", "seq", "accepted")
