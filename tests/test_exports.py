"""Raw exports: dialects, error rows, odd values, rejected payloads."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wattfold.operators import clean
from wattfold.sources import archives, exports, sinks

TIME = exports.TIME_HEADER


def tsv(header, *rows):
    return "\n".join("\t".join(r) for r in (header, *rows)) + "\n"


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    root = tmp_path_factory.mktemp("exports")
    main = exports.MAIN_METER_HEADERS
    (root / "AA01_3.csv").write_text(
        tsv(
            [TIME, "error", main["kw"], main["power_factor"], "Unknown Column"],
            ["2024-07-01 10:00:00", "0", "12.34567", "0.98", "x"],
            ["2024-07-01 10:15:00", "5", "50", "0.97", "x"],
            ["2024-07-01 10:30:00", "x", "51", "0.97", "x"],
            ["2024-07-01 10:45:00", "0.0", "52", "0.97", "x"],
            ["2024-07-01 11:00:00", " 0 ", "53", "nan", "x"],
            ["2024-07-01 11:15:00", "0", "", "0.97", "x"],
            ["2024-07-01 11:30:00", "0", "nan", "0.97", "x"],
            ["2024-07-01 11:45:00", "0", "2e8", "0.97", "x"],
            ["2024-07-01 12:00:00", "0", "54"],
        )
    )
    panel = exports.PANEL_HEADERS
    (root / "AA01_76.csv").write_text(
        tsv(
            [panel["thd_v1"], TIME, panel["kw"], panel["kwh_delivered"]],  # other order, no error column
            ["3276.8", "2024-07-01 10:00:00", "7.5", "100"],
            ["1.5", "2024-07-01 10:15:00", "ten", "100"],
            ["1.5", "2024-07-01 10:30:00", "8.25d", "100"],
            ["1.5", "2024-07-01 10:45:00", "9", "100"],
        ).replace("\n", "\r\n")
    )
    (root / "AA01_77.csv").write_text("")
    (root / "AA02_3.csv").write_text("<!DOCTYPE html>\n<HTML><body>please log in</body></HTML>")
    (root / "AA03_9.csv").write_text(
        tsv(
            [TIME, "error", "kW total (kW)", "Total kWh", "Spare kW", "Other kW"],
            ["2024-07-01 10:00:00", "0", "60000", "5", "-1", "3.25"],
        )
    )
    (root / "AA04_1.csv").write_text(
        tsv([TIME, "error", "kW", "kW total (kW)"], ["2024-07-01 10:00:00", "9", "11", "0"], ["2024-07-01 10:15:00", "9", "11.26", "bad"])
    )
    return str(root)


def test_power(spark, landing):
    rows = exports.read_power(spark, landing).orderBy("mac", "meter", "line").collect()
    main = [r for r in rows if r["meter"] == "3"]
    assert [(r["line"], r["kw"], r["power_factor"]) for r in main] == [(0, 12.346, 0.98), (4, 53.0, None), (8, 54.0, None)]
    assert main[0]["thd_v1"] is None and main[0]["local_time"] == "2024-07-01 10:00:00"
    assert main[0]["ts"].isoformat() == "2024-07-01T17:00:00"  # summer time, seven hours behind UTC
    panel = [r for r in rows if r["meter"] == "76"]
    assert [(r["kw"], r["thd_v1"], r["kwh_delivered"]) for r in panel] == [(7.5, 3276.8, 100.0), (9.0, 1.5, 100.0)]
    assert len(panel[0].asDict()) == len(exports.POWER_MEASURES) + 5


def test_error_rows_can_stay(spark, landing):
    rows = exports.read_power(spark, landing, drop_errors=False).filter("meter = '3'")
    assert rows.count() == 6


def test_rejected(spark, landing):
    assert [(r["mac"], r["meter"]) for r in exports.rejected_payloads(spark, landing).collect()] == [("AA02", "3")]


def test_latest_loads(spark, landing):
    got = {(r["mac"], r["meter"]): r["kw"] for r in exports.read_latest_loads(spark, landing).collect()}
    assert got[("AA01", "3")] == 54.0
    assert got[("AA03", "9")] == 3.2  # first column in range that names kW but not kWh; 3.25 is a tie
    assert got[("AA04", "1")] == 11.3  # last line, error flag not looked at, next candidate after a bad one
    assert ("AA02", "3") not in got and ("AA01", "77") not in got


def test_repeated_header_takes_the_last(spark, tmp_path):
    (tmp_path / "A_1.csv").write_text(tsv([TIME, "kW", "kW"], ["2024-07-01 10:00:00", "1", "2"]))
    assert exports.read_latest_loads(spark, str(tmp_path)).first()["kw"] == 2.0


def test_water(spark, tmp_path):
    head = [TIME, "error", *exports.WATER_HEADERS.values()]
    full = ["2024-07-01 10:00:00", "0", *[str(i) for i in range(10)]]
    empty = ["2024-07-01 10:15:00", "0", *[""] * 10]
    one = ["2024-07-01 10:30:00", "0", *[""] * 9, "4.5"]
    failed = ["2024-07-01 10:45:00", "1", *["1"] * 10]
    (tmp_path / "AA01_250.csv").write_text(tsv(head, full, empty, one, failed))
    rows = exports.read_water(spark, str(tmp_path)).orderBy("line").collect()
    assert [r["line"] for r in rows] == [0, 2]
    assert rows[1]["water2_rate_cfm"] == 4.5 and rows[0]["steam_total_gal"] == 0.0


def test_wide_columns(spark):
    raw = spark.createDataFrame([("60000", "5", "-1", "3.25")], "`kW total (kW)` string, `Total kWh` string, `Spare kW` string, `Other kW` string")
    assert clean.resolve_kw(raw, candidates=exports.KW_HEADERS).first()["kw"] == 3.2


def test_missing_error_column_keeps_rows(spark):
    assert clean.drop_error_rows(spark.range(3).toDF("kw")).count() == 3


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    head, n = [TIME, "error", "kW"], 5000
    rows = [[f"2024-07-01 {i // 3600 % 24:02d}:{i // 60 % 60:02d}:{i % 60:02d}", "0", str(i)] for i in range(n)]
    (tmp_path / "A_1.csv").write_text("\n" + tsv(head, *rows).replace("\n", "\n\n"))  # empty lines do not count
    (tmp_path / "B_1.csv").write_text("\n".join(["one", "two", "<HTML>"] + ["x"] * 5000))
    whole = sorted((r["line"], r["cells"]["kW"]) for r in exports.read_export(spark, str(tmp_path)).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = exports._lines(spark, str(tmp_path))
        assert lines.filter("mac = 'A'").select("block").distinct().count() > 5 and lines.rdd.getNumPartitions() > 5
        cut = sorted((r["line"], r["cells"]["kW"]) for r in exports.read_export(spark, str(tmp_path)).collect())
        assert [r["mac"] for r in exports.rejected_payloads(spark, str(tmp_path)).collect()] == ["B"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert cut == whole == [(i, str(i)) for i in range(n)]


# --- JSON stores ----------------------------------------------------------------------


def test_history_missing_corrupt_and_good(spark, tmp_path):
    assert archives.read_history(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{not json")
    assert archives.read_history(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "h.json").write_text('{"a": [{"kw": 1.5, "ts": "x", "t": "10:00"}, {"kw": 2.5, "ts": "y", "t": "10:15"}]}')
    rows = archives.read_history(spark, str(tmp_path / "h.json")).collect()
    assert [(r["bid"], r["pos"], r["kw"], r["t"]) for r in rows] == [("a", 0, 1.5, "10:00"), ("a", 1, 2.5, "10:15")]


def test_snapshots_skip_what_does_not_fit(spark, tmp_path):
    (tmp_path / "2026-01-01.json").write_text('{"generated_at": "2026-01-01 10:00:00", "buildings": {"a": {"kw": 1.0, "sparkline": [1.0, null, 2.0]}}}')
    (tmp_path / "2026-01-02.json").write_text('{"timestamp": "2026-01-02T10:00:00Z", "buildings": {"a": {"kw": 2.0, "sparkline": []}}}')
    (tmp_path / "2026-01-03.json").write_text("{broken")
    (tmp_path / "2026-01-04.json").write_text('{"generated_at": "2026-01-04 10:00:00"}')
    (tmp_path / "2026-01-05.json").write_text('{"buildings": {}}')
    (tmp_path / "2026-01-06.json").write_text('{"generated_at": "soon", "buildings": {}}')
    (tmp_path / "buildings_2026.json").write_text('{"generated_at": "2026-01-04 10:00:00", "buildings": {"z": {}}}')
    snaps = archives.read_snapshots(spark, str(tmp_path))
    assert [r["file"] for r in archives.source_files(snaps).collect()] == ["2026-01-01.json", "2026-01-02.json"]
    from wattfold.plans.jobs import snapshot_samples

    points = snapshot_samples(snaps, compat=True).orderBy("ts").collect()
    assert [(p["ts"], p["kw"]) for p in points] == [(datetime(2026, 1, 1, 9, 30), 1.0), (datetime(2026, 1, 1, 10, 0), 2.0)]


def test_daily_reads_only_the_days_asked_for(spark, tmp_path):
    for day in ("2026-01-01", "2026-01-02", "2026-01-04"):
        (tmp_path / f"{day}.json").write_text(
            '{"date": "%s", "readings": [{"time": "10:00", "total_kw": 3.0, "online": 2, "buildings": {"a": 1.0, "b": 2.0}}]}' % day
        )
    (tmp_path / "index.json").write_text('{"days": ["2026-01-01"], "updated": "x"}')
    rows = archives.read_daily(spark, str(tmp_path), start="2026-01-02", end="2026-01-04")
    assert sorted(str(r["date"]) for r in rows.collect()) == ["2026-01-02", "2026-01-04"]
    assert len(rows.inputFiles()) == 2
    assert archives.building_readings(archives.read_daily(spark, str(tmp_path))).count() == 6


def test_document_limit_and_order(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "id string, v double")
    doc = sinks.as_map(rows, "id", F.col("v"), "m", order=-F.col("v")).select(F.to_json("m")).first()[0]
    assert doc == '{"b":3.0,"c":2.0,"a":1.0}'
    with pytest.raises(ValueError):
        sinks.as_map(rows, "id", F.col("v"), "m", limit=2)


def test_daily_append_is_pruned_by_date(spark, tmp_path):
    rows = spark.createDataFrame([("a", datetime(2026, 1, d, 10), 1.0) for d in (1, 1, 2, 3)], "bid string, ts timestamp_ntz, kw double")
    for _ in range(2):
        sinks.append_daily(rows, str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d")).filter("date = DATE'2026-01-01'")
    assert back.count() == 4 and len(back.inputFiles()) <= 4 * 8
