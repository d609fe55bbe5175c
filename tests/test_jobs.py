"""Whole jobs on small inputs."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattfold.operators import baselines, clean, dimensions, latest, rollups
from wattfold.plans import jobs
from wattfold.sources import archives, exports


@pytest.fixture(scope="module")
def registry(spark):
    rows = [
        ("hall", 1, "First Hall", "M1", ["3", "76"]),
        ("lab", 2, "Lab", "M2", ["1"]),
        ("lab", 3, "Lab (Legacy)", "M3", ["9"]),
        ("twin", 4, "Twin", "M1", ["3"]),
        ("dark", 5, "Dark Hall", "M5", ["1", "2"]),
    ]
    return spark.createDataFrame(rows, "id string, ordinal int, name string, mac string, meters array<string>")


def loads(spark, *rows):
    at = datetime(2026, 1, 1, 10)
    return spark.createDataFrame([(m, n, k, at + timedelta(minutes=i)) for i, (m, n, k) in enumerate(rows)],
                                 "mac string, meter string, kw double, ts timestamp_ntz")


def test_resolution_order(spark, registry):
    now = loads(spark, ("M1", "3", None), ("M1", "76", 20.0), ("M2", "1", None), ("M3", "9", 5.0), ("M5", "1", None), ("M5", "2", None))
    got = {r["id"]: r for r in latest.resolve_buildings(registry, now).collect()}
    assert (got["hall"]["kw"], got["hall"]["meter"]) == (20.0, "76")
    assert (got["lab"]["kw"], got["lab"]["mac"], got["lab"]["name"]) == (5.0, "M3", "Lab")
    assert got["twin"]["kw"] is None and got["twin"]["meter"] is None
    assert got["dark"]["ts"] == datetime(2026, 1, 1, 10, 5)  # time of the last meter that was asked
    assert [(r["mac"], r["meter"], r["buildings"]) for r in dimensions.shared_meters(registry).collect()] == [("M1", "3", 2)]


def test_first_row_wins_when_both_have_loads(spark, registry):
    now = loads(spark, ("M2", "1", 7.0), ("M3", "9", 5.0))
    got = {r["id"]: r["kw"] for r in latest.resolve_buildings(registry, now).collect()}
    assert got["lab"] == 7.0


def test_cycles(spark, registry, tmp_path):
    out = str(tmp_path / "campus")
    series = [10.0, 20.0, 30.0, 40.0, 100.0, None]
    for cycle, kw in enumerate(series):
        now = loads(spark, ("M1", "3", kw), ("M2", "1", 0.04 if cycle == 4 else 1.0))
        jobs.run_cycle(spark, registry, now, out, cycle=cycle, now=f"2026-01-01 10:{cycle * 5:02d}:00")
    snapshot = {r["bid"]: r for r in spark.read.parquet(f"{out}/snapshot/cycle=4").collect()}
    hall = snapshot["hall"]
    assert hall["sparkline"] == [10.0, 20.0, 30.0, 40.0, 100.0]
    assert hall["anomaly"].asDict() == {"type": "high", "current": 100.0, "avg": 40.0, "ratio": 2.5}
    assert hall["predicted_kw"] == 60.0  # (20*1 + 30*2 + 40*3 + 100*4) / 10
    assert (hall["est_daily_kwh"], hall["est_daily_cost"], hall["est_daily_co2_kg"]) == (2400, 360.0, 504.0)
    gone = {r["bid"]: r for r in spark.read.parquet(f"{out}/snapshot/cycle=5").collect()}["hall"]
    assert (gone["kw"], gone["status"], gone["anomaly"], gone["predicted_kw"]) == (None, "offline", None, 60.0)
    document = json.loads(spark.read.text(f"{out}/campus_energy").first()[0])
    assert document["buildings_total"] == 4 and document["buildings_online"] == 1 and document["total_kw"] == 1.0
    assert document["buildings"]["hall"]["kw"] is None and document["anomalies"] == {}
    assert spark.read.parquet(f"{out}/history/cycle=5").filter("bid = 'hall'").count() == 5
    again = loads(spark, ("M1", "3", None), ("M2", "1", 1.0))
    jobs.run_cycle(spark, registry, again, out, cycle=5, now="2026-01-01 10:25:00")  # a repeated cycle adds nothing
    assert spark.read.parquet(f"{out}/campus").count() == 6
    assert archives.snapshot_buildings(archives.read_snapshots(spark, f"{out}/campus_energy", glob="*.json")).count() == 4


def test_cycles_from_a_stream(spark, registry, tmp_path):
    """Landed loads drive one cycle per micro-batch."""
    from wattfold.streaming import readings as streams

    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    for kw in (10.0, 30.0):
        loads(spark, ("M1", "3", kw)).coalesce(1).write.mode("append").parquet(landed)
    stream = streams.read_stream(spark, landed, "mac string, meter string, kw double, ts timestamp_ntz", files_per_trigger=1)

    def run(batch, cycle):
        now = f"2026-01-01 10:{cycle:02d}:00"
        jobs.run_cycle(spark, registry, latest.latest(batch, by=["mac", "meter"], order=["ts"]), out, cycle=cycle, now=now)

    job = streams.start_cycles(stream, run, marks=str(tmp_path / "marks"), once=True)
    job.awaitTermination()
    got = spark.read.parquet(f"{out}/snapshot/cycle=1").filter("bid = 'hall'").first()
    assert got["sparkline"] == [10.0, 30.0] and got["predicted_kw"] == 23.3


def test_history_is_cut(spark):
    rows = [("a", datetime(2026, 1, 1) + timedelta(minutes=15 * i), i, float(i)) for i in range(96)]
    history = spark.createDataFrame(rows, "bid string, ts timestamp_ntz, seq bigint, kw double")
    current = spark.createDataFrame([("a", 500.0), ("b", None)], "bid string, kw double")
    kept = jobs.extend_history(history, current, now="2026-01-02 00:00:00")
    assert kept.count() == 96 and kept.agg(F.min("kw"), F.max("kw")).first()[:] == (1.0, 500.0)


def campus_rows(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp_ntz, total_kw double, online int").withColumn("date", F.to_date("ts"))


def test_weekly_corner_cases(spark):
    rows = [
        (datetime(2026, 1, 1, 9), 10.0, 2), (datetime(2026, 1, 1, 10), 30.0, 3), (datetime(2026, 1, 1, 11), 30.0, 0),
        (datetime(2026, 1, 2, 9), 0.0, 0),  # a day without load keeps its row and counts as a day
        (datetime(2025, 12, 1, 9), 999.0, 9),
    ]
    loads = spark.createDataFrame([("a", datetime(2026, 1, 1, 9), 0.0), ("b", datetime(2026, 1, 1, 9), 4.0)], "bid string, ts timestamp_ntz, kw double")
    names = spark.createDataFrame([("a", "A Hall")], "bid string, name string")
    report = jobs.weekly_report(campus_rows(spark, rows), loads.withColumn("date", F.to_date("ts")), as_of="2026-01-02", names=names)
    first, second = report.days.orderBy("date").collect()
    assert (first["avg_kw"], first["peak_kw"], first["peak_time"], first["avg_online"], first["day"]) == (23.3, 30.0, "10:00", 2, "Thursday")
    assert (second["avg_kw"], second["peak_time"], second["readings_count"], second["est_cost"]) == (0.0, "", 1, 0.0)
    assert [(r["bid"], r["name"]) for r in report.buildings.collect()] == [("b", "b")]
    week = report.campus.first()
    assert (week["days"], week["total_readings"], week["total_kwh"]) == (2, 3, 1118.0)


def test_week_over_week(spark):
    rows = [(datetime(2026, 1, 5) + timedelta(days=7 * w), kw, 1) for w, kw in enumerate((10.0, 15.0, 0.0, 12.0))]
    got = rollups.week_over_week(campus_rows(spark, rows)).orderBy("week").collect()
    assert [r["change_pct"] for r in got] == [None, 50.0, -100.0, None]


def test_baselines_and_forecast(spark):
    from statistics import mean, pstdev

    monday = datetime(2026, 1, 5, 8)
    rows = [("a", monday + timedelta(days=7 * i), float(10 + i)) for i in range(3)]
    rows += [("a", monday + timedelta(days=1), 40.0), ("a", datetime(2026, 1, 10, 8), 50.0), ("b", monday, 5.0)]
    cells = baselines.baselines(spark.createDataFrame(rows, "bid string, ts timestamp_ntz, kw double")).cache()
    tier1 = cells.filter("tier = 1").collect()
    assert [(r["bid"], r["wday"], r["hr"], r["mean"], r["std"], r["n"]) for r in tier1] == [("a", 0, 8, 11.0, round(pstdev([10, 11, 12]), 2), 3)]
    assert [(r["wclass"], r["n"]) for r in cells.filter("tier = 2").collect()] == [("weekday", 4)]
    targets = [("a", datetime(2026, 2, 2, 8)), ("a", datetime(2026, 2, 3, 8)), ("a", datetime(2026, 2, 7, 8)), ("a", datetime(2026, 2, 7, 9)),
               ("b", datetime(2026, 2, 2, 8)), ("c", datetime(2026, 2, 2, 8))]
    got = baselines.forecast(cells, spark.createDataFrame(targets, "bid string, ts timestamp_ntz")).collect()
    tiers = {(r["bid"], r["ts"]): (r["tier"], r["mean"], r["std"]) for r in got}
    assert tiers[targets[0]][0] == 1 and tiers[targets[1]][0] == 2 and tiers[targets[2]][0] == 3
    everything = [v for b, _, v in rows if b == "a"]
    assert tiers[targets[3]] == (4, round(mean(everything), 2), round(pstdev(everything), 2))
    assert tiers[targets[4]] == (4, 5.0, 0.0) and tiers[targets[5]] == (None, None, None)
    pacific = baselines.baselines(spark.createDataFrame(rows, "bid string, ts timestamp_ntz, kw double"), tz="US/Pacific")
    assert {r["hr"] for r in pacific.filter("tier = 3").collect()} == {0}


def test_floor_allocation_keeps_the_sum(spark):
    shares = [("B1", "76", 0.55), ("B1", "77", 0.16), ("L1", "76", 0.45), ("L1", "77", 0.31), ("L2", "77", 0.35), ("L3", "77", 0.18), ("SRV", "3", 1.0)]
    table = spark.createDataFrame(shares, "floor string, meter string, share double")
    loads = spark.createDataFrame([("3", 10.0), ("76", 20.0), ("77", 30.5)], "meter string, kw double")
    got = {r["floor"]: r["kw"] for r in dimensions.floor_allocation(loads, table).collect()}
    assert got == {"B1": 15.88, "L1": 18.455, "L2": 10.675, "L3": 5.49, "SRV": 10.0}
    assert round(sum(got.values()), 6) == 60.5 and dimensions.share_check(table).count() == 0
    assert dimensions.share_check(table.filter("floor <> 'L3'")).first()["meter"] == "77"


def test_dashboard(spark):
    rows = [("a", "A", 120.0), ("b", "B", 60.0), ("c", "C", None), ("d", "D", 0.0)]
    snapshot = spark.createDataFrame(rows, "bid string, name string, kw double").withColumn(
        "anomaly", F.when(F.col("bid") == "a", F.struct(F.lit("high").alias("type"), F.col("kw").alias("current"), F.lit(60.0).alias("avg"), F.lit(2.0).alias("ratio")))
    )
    attributes = spark.createDataFrame([("a", "Science", 4, 1980), ("b", "Science", None, None)], "bid string, category string, floors int, year_built int")
    page = jobs.dashboard(snapshot, attributes)
    assert {r["bid"]: r["band"] for r in page.table.collect()} == {"a": "very_high", "b": "mid", "c": "none", "d": "none"}
    assert [(r["category"], r["kw"], r["share_pct"]) for r in page.categories.collect()] == [("Science", 180.0, 100)]
    assert {r["bid"]: (r["floors"], r["kw_per_floor"]) for r in page.efficiency.collect()} == {"a": (4, 30.0), "b": (3, 20.0), "d": (3, 0.0)}
    assert [r["bid"] for r in page.top_load.collect()] == ["a", "b", "d"]
    assert page.anomalies.first()["deviation_pct"] == 100
    assert [r["bid"] for r in rollups.age_vs_energy(page.efficiency).collect()] == ["a"]
    empty = rollups.with_relative_band(snapshot.filter("kw IS NULL"))
    assert [r["band"] for r in empty.collect()] == ["none"]


def test_interior(spark, tmp_path):
    head = [exports.TIME_HEADER, "error"]
    day = "2026-01-05"
    main = exports.MAIN_METER_HEADERS
    lines = ["\t".join([*head, main["kw"], main["power_factor"], main["current_avg"]])]
    lines += [f"{day} {h:02d}:00:00\t0\t{kw}\t95\t{kw * 2}" for h, kw in ((1, 10.0), (2, 30.0), (3, 30.0), (4, 20.0))]
    (tmp_path / "M1_3.csv").write_text("\n".join(lines))
    meters = spark.createDataFrame([("3", 1, "Roof"), ("76", 2, "Panel")], "meter string, ord int, name string")
    readings = exports.read_power(spark, str(tmp_path)).withColumn("ts", F.to_timestamp_ntz("local_time"))
    got = jobs.building_summary(readings, meters, as_of=f"{day} 12:00:00")
    by_meter = {r["meter"]: r for r in got.meters.collect()}
    assert by_meter["76"]["status"] == "offline" and by_meter["3"]["status"] == "online"
    stats = by_meter["3"]["stats_today"]["kw"]
    assert by_meter["3"]["latest"]["kw"] == 20.0 and by_meter["3"]["latest"]["timestamp"] == f"{day} 04:00:00"
    assert by_meter["3"]["stats_today"]["current"]["max"] == 60.0
    assert (stats["current"], stats["max"], stats["avg"], stats["count"]) == (20.0, 30.0, 22.5, 4)
    assert stats["peak_time"] == datetime(2026, 1, 5, 2)
    assert [p["v"] for p in by_meter["3"]["timeseries_kw"]] == [10.0, 30.0, 30.0, 20.0]
    assert got.summary.first().asDict() == {"total_kw_now": 20.0, "meters_online": 1, "kw_3": 20.0, "kw_76": None}
    assert (got.peak.first()["peak_meter"], got.peak.first()["peak_kw"]) == ("3", 30.0)
    from wattfold.sources import sinks

    sinks.write_document(jobs.interior_document(got, generated_at="x", building={"name": "Hall"}), str(tmp_path / "doc"))
    back = {r["meter"]: r for r in archives.read_interior(spark, str(tmp_path / "doc")).collect()}
    assert back["3"]["stats_today"]["kw"]["max"] == 30.0 and back["76"]["status"] == "offline"


def test_water(spark, tmp_path):
    head = [exports.TIME_HEADER, "error", *exports.WATER_HEADERS.values()]
    lines = ["\t".join(head)]
    for hour, flow in ((1, "1.5"), (2, ""), (3, "2.5")):
        cells = {exports.WATER_HEADERS["water1_rate_cfm"]: flow, exports.WATER_HEADERS["steam_rate_gpm"]: "7"}
        lines.append("\t".join([f"2026-01-05 {hour:02d}:00:00", "0", *[cells.get(h, "") for h in head[2:]]]))
    (tmp_path / "M1_250.csv").write_text("\n".join(lines))
    readings = exports.read_water(spark, str(tmp_path)).withColumn("ts", F.to_timestamp_ntz("local_time"))
    got = jobs.water_summary(readings, as_of="2026-01-05 12:00:00").first()
    assert got["latest"]["water1_rate_cfm"] == 2.5
    assert got["stats_today"]["water_rate"]["avg"] == 2.0 and got["stats_today"]["steam_rate"]["count"] == 3
    assert [p["v"] for p in got["timeseries_water"]] == [1.5, 2.5]


def test_dimension_files(spark, tmp_path):
    from wattfold.sources import dimensions as dims

    (tmp_path / "registry.json").write_text(
        '{"id": "a", "name": "A", "mac": "M", "db": "d", "meters": ["3", "76"]}\n{"id": "a", "name": "A (Legacy)", "mac": "N", "meters": ["1"]}\n'
    )
    rows = dims.read_registry(spark, str(tmp_path / "registry.json")).orderBy("ordinal").collect()
    assert [r["mac"] for r in rows] == ["M", "N"] and rows[0]["meters"] == ["3", "76"]
    (tmp_path / "shares.csv").write_text("floor,meter,share\nB1,76,0.55\n")
    assert dims.read_shares(spark, str(tmp_path / "shares.csv")).first()[:] == ("B1", "76", 0.55)
    (tmp_path / "votes.json").write_text('{"building": "a", "vote": "hot", "ts": "2026-01-01T10:00:00"}\n{"building": "a", "vote": "maybe"}\n')
    assert dims.read_votes(spark, str(tmp_path / "votes.json")).count() == 1


def test_peak_time_skips_nulls(spark):
    rows = [("a", datetime(2026, 1, 1, h), h, kw) for h, kw in ((1, None), (2, 5.0), (3, None), (4, 9.0), (5, 9.0))]
    df = spark.createDataFrame(rows, "bid string, ts timestamp_ntz, seq bigint, kw double")
    got = rollups.series_stats(df, by=["bid"]).first()
    assert (got["peak_time"], got["current"], got["count"]) == (datetime(2026, 1, 1, 4), 9.0, 3)


def test_filters_reach_the_scan(spark, sf_dir, capsys):
    from wattfold.sources import tables

    clean.on_day(tables.readings(spark, sf_dir), as_of="2024-01-15").explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
