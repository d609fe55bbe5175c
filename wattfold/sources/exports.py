"""Raw meter exports: tab-separated files named <mac>_<meter>.csv."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattfold.functions.clock import meter_time_to_utc
from wattfold.operators.clean import any_measure_present, drop_error_rows, normalize, require, resolve_kw, sniff_html
from wattfold.operators.latest import latest

# Export headers. Canonical measure -> header, for each dialect.
TIME_HEADER, ERROR_HEADER = "time (US/Pacific)", "error"
MAIN_METER_HEADERS = {
    "kw": "Active Power Total (kW)",
    "kw_a": "Active Power A (kW)",
    "kw_b": "Active Power B (kW)",
    "kw_c": "Active Power C (kW)",
    "kva": "Apparent Power Total (kVA)",
    "kvar": "Reactive Power Total (kVAR)",
    "power_factor": "Power Factor Total (PF)",
    "pf_a": "Power Factor A (PF)",
    "pf_b": "Power Factor B (PF)",
    "pf_c": "Power Factor C (PF)",
    "current_a": "Current A (Amps)",
    "current_b": "Current B (Amps)",
    "current_c": "Current C (Amps)",
    "current_avg": "Current Avg (Amps)",
    "voltage_ll": "Voltage L-L Avg (Volts)",
    "voltage_ln": "Voltage L-N Avg (Volts)",
    "frequency": "Frequency (Hz)",
    "kwh_delivered": "Active Energy Delivered (Into Load) (kWh)",
    "demand_kw": "Active Power Present Demand (kW)",
    "peak_demand_kw": "Active Power Peak Demand (kW)",
}
PANEL_HEADERS = {
    "kw": "kW total (kW)",
    "kw_a": "kW a (kW)",
    "kw_b": "kW b (kW)",
    "kw_c": "kW c (kW)",
    "kva": "kVA total (kVA)",
    "kvar": "kVAR total (kVAR)",
    "power_factor": "PF sign total",
    "current_a": "I a (Amps)",
    "current_b": "I b (Amps)",
    "current_c": "I c (Amps)",
    "current_avg": "I ave (Amps)",
    "voltage_ll": "Vll ave (Volts)",
    "voltage_ln": "Vln ave (Volts)",
    "frequency": "Frequency (Hz)",
    "kwh_delivered": "kWh del (kWh)",
    "demand_kw": "kW demand (kW)",
    "peak_demand_kw": "kW peak demand (kW)",
    "thd_v1": "V1 THD (%)",
    "thd_v2": "V2 THD (%)",
    "thd_v3": "V3 THD (%)",
    "thd_i1": "I1 THD (%)",
    "thd_i2": "I2 THD (%)",
    "thd_i3": "I3 THD (%)",
}
WATER_HEADERS = {
    "steam_total_gal": "Steam Condensate Meter (Gal)",
    "steam_rate_gpm": "Steam Condensate Meter Ave Rate (Gpm)",
    "steam_instant_gpm": "Steam Condensate Meter Instantaneous (Gpm)",
    "irrigation_total_gal": "Irrigation Water ABADBECH (Gallons)",
    "irrigation_rate_gpm": "Irrigation Water ABADBECH Ave Rate (Gpm)",
    "water1_total_cf": "Water 70313687 (Cubic Feet)",
    "water1_rate_cfm": "Water 70313687 Ave Rate (CFm)",
    "water1_instant_cfm": "Water 70313687 Instantaneous (CFm)",
    "water2_total_cf": "Water 70313686 (Cubic Feet)",
    "water2_rate_cfm": "Water 70313686 Ave Rate (CFm)",
}
KW_HEADERS = (
    "kW total (kW)", "Active Power Total (kW)", "kW total", "kW",
    "kW del-rec (kW)", "Power Total (kW)", "kW del (kW)",
    "Watts Total (kW)", "Watts, Total (kW)", "kW Total (kW)",
)
MAIN_METERS = ("3",)

POWER_MEASURES = tuple(dict.fromkeys((*MAIN_METER_HEADERS, *PANEL_HEADERS)))
WATER_MEASURES = tuple(WATER_HEADERS)


def _file_part(group: int) -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"([^/_]+)_([^/_.]+)\.[^.]+$", group)


#: So many characters are looked at to tell a web page from an export; lines of which there can be no more than that.
_SNIFFED = 200


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines that are not empty: file, mac, meter, block and at (the line's place within the block of the file).

    The built-in text reader splits large files, so one export may be read by several tasks.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        _file_part(1).alias("mac"),
        _file_part(2).alias("meter"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    ).filter("value <> ''")


def _heads(lines: DataFrame) -> DataFrame:
    """One row per file: file, mac, meter, header (cells of its first line) and rejected."""
    early = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    first = lines.filter("block = 0").withColumn("n", early).filter(F.col("n") <= _SNIFFED)
    start = F.transform(F.array_sort(F.collect_list(F.struct("n", F.substring("value", 1, _SNIFFED).alias("v")))), lambda x: x["v"])
    files = first.groupBy("file", "mac", "meter").agg(F.min_by("value", "n").alias("_first"), F.array_join(start, "\n").alias("_start"))
    marked = sniff_html(files, payload="_start", chars=_SNIFFED)
    return marked.select("file", "mac", "meter", F.split("_first", "\t").alias("header"), "rejected")


def rejected_payloads(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return _heads(_lines(spark, path)).filter("rejected").select("file", "mac", "meter")


def read_export(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per data line: mac, meter, line (from 0), cells (header -> text).

    Cells are found by name, so the order and set of columns may differ between files.
    Lines shorter than the header have null cells; of equal names the last counts. A line's number is its place in its
    block plus the lines of the blocks before; header and that number go to the lines block by block, so a large file
    is not one task's.
    """
    lines = _lines(spark, path)
    last_of_name = F.filter(
        F.sequence(F.lit(1), F.size("header")),
        lambda i: F.array_position(F.reverse("header"), F.get("header", i - 1)) == F.size("header") - i + 1,
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
    heads = _heads(lines).filter("not rejected").select("file", "header", last_of_name.alias("_at"))
    blocks = blocks.join(heads, "file").select("file", "block", "offset", "header", "_at")
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    numbered = lines.withColumn("_place", place).join(blocks, ["file", "block"]).withColumn("line", (F.col("offset") + F.col("_place") - 2).cast("int"))
    # An explode, not a filter, leaves header lines out: later filters on parsed cells are not moved before it.
    data = F.explode(F.when(F.col("line") >= 0, F.array("value"))).alias("value")
    rows = numbered.select("mac", "meter", "line", "header", "_at", data).withColumn("_cells", F.split("value", "\t"))
    pairs = F.transform("_at", lambda i: F.struct(F.get("header", i - 1).alias("k"), F.get("_cells", i - 1).alias("v")))
    return rows.select("mac", "meter", "line", F.map_from_entries(pairs).alias("cells"))


def _rows(raw: DataFrame, drop_errors: bool) -> DataFrame:
    rows = raw.withColumns(
        {
            "error": F.try_element_at("cells", F.lit(ERROR_HEADER)),
            "local_time": F.coalesce(F.try_element_at("cells", F.lit(TIME_HEADER)), F.lit("")),
        }
    )
    return drop_error_rows(rows) if drop_errors else rows


def read_power(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    dialects: tuple[Mapping[str, str], Mapping[str, str]] = (MAIN_METER_HEADERS, PANEL_HEADERS),
    main_meters: Sequence[str] = MAIN_METERS,
    drop_errors: bool = True,
    tz: str = "US/Pacific",
) -> DataFrame:
    """Power readings: mac, meter, line, local_time, ts and every measure; the first dialect
    is for ``main_meters``, the second for all other meters. Rows without a load drop out."""
    rows = _rows(read_export(spark, path), drop_errors)
    keep = ["mac", "meter", "line", "local_time"]
    is_main = F.col("meter").isin(*main_meters)
    known = normalize(rows, [(is_main, dialects[0]), (F.lit(True), dialects[1])], keep, POWER_MEASURES, cells="cells")
    return require(known).withColumn("ts", meter_time_to_utc(F.col("local_time"), tz))


def read_water(
    spark: SparkSession, path: str | Sequence[str], *, drop_errors: bool = True, tz: str = "US/Pacific"
) -> DataFrame:
    """Water and steam readings; a row stays if any measure has a value."""
    rows = _rows(read_export(spark, path), drop_errors)
    keep = ["mac", "meter", "line", "local_time"]
    out = any_measure_present(normalize(rows, WATER_HEADERS, keep, WATER_MEASURES, cells="cells"), WATER_MEASURES)
    return out.withColumn("ts", meter_time_to_utc(F.col("local_time"), tz))


def read_latest_loads(spark: SparkSession, path: str | Sequence[str], *, tz: str = "US/Pacific") -> DataFrame:
    """mac, meter, kw, ts of the last line of each meter's export. The load follows the
    priority list of headers; the error flag is not looked at."""
    raw = _rows(read_export(spark, path), drop_errors=False)
    loads = resolve_kw(raw, candidates=KW_HEADERS, cells="cells")
    stamped = loads.select("mac", "meter", "line", "kw", meter_time_to_utc(F.col("local_time"), tz).alias("ts"))
    return latest(stamped, by=["mac", "meter"], order=["ts", "line"]).select("mac", "meter", "kw", "ts")
