"""Archive ranges open on one side, snapshots of several years, buildings without meters."""

import json

from wattfold.operators import latest
from wattfold.sources import archives


def test_daily_range_open_on_one_side(spark, tmp_path):
    for day in ("2025-12-31", "2026-01-01", "2026-01-02"):
        reading = {"time": "00:15", "total_kw": 1.0, "online": 1, "buildings": {"a": 1.0}}
        (tmp_path / f"{day}.json").write_text(json.dumps({"date": day, "readings": [reading]}))
    days = lambda **k: sorted(str(r["date"]) for r in archives.read_daily(spark, str(tmp_path), **k).collect())
    assert days(start="2026-01-01") == ["2026-01-01", "2026-01-02"]
    assert days(end="2026-01-01") == ["2025-12-31", "2026-01-01"]
    assert days(start="2026-01-01", end="2026-01-01") == ["2026-01-01"] and len(days()) == 3


def test_snapshots_of_any_year(spark, tmp_path):
    for day in ("2025-12-31", "2026-01-01"):
        (tmp_path / f"{day}-00.json").write_text(json.dumps({"generated_at": f"{day}T00:00:00Z", "buildings": {"a": {}}}))
    assert archives.read_snapshots(spark, str(tmp_path)).count() == 2


def test_building_without_meters_stays(spark):
    registry = spark.createDataFrame([("a", 1, "A", "m", []), ("b", 2, "B", "m", None)], "id string, ordinal int, name string, mac string, meters array<string>")
    loads = spark.createDataFrame([], "mac string, meter string, kw double, ts timestamp")
    got = latest.resolve_buildings(registry, loads).orderBy("id").collect()
    assert [(r["id"], r["kw"]) for r in got] == [("a", None), ("b", None)]
