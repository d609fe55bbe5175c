"""Daily store, quarantine of unreadable documents, sharded documents, cycles that go on."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattfold.plans import jobs
from wattfold.sources import archives, sinks

DAY = datetime(2026, 1, 1)


def readings(spark, days, times=1.0):
    rows = [(f"b{i % 3}", DAY + timedelta(days=d, hours=i), float(i) * times) for d in days for i in range(24)]
    return spark.createDataFrame(rows, "bid string, ts timestamp_ntz, kw double")


def test_a_day_written_again_replaces_that_day_only(spark, tmp_path):
    path = str(tmp_path / "days")
    sinks.write_days(readings(spark, range(5)), path)
    sinks.write_days(readings(spark, [2], times=2.0), path)
    sums = {str(r["date"]): r["kw"] for r in sinks.read_days(spark, path).groupBy("date").agg(F.sum("kw").alias("kw")).collect()}
    assert sums == {f"2026-01-0{d + 1}": 276.0 * (2 if d == 2 else 1) for d in range(5)}
    assert sinks.stored_days(spark, path) == sorted(sums) and sinks.stored_days(spark, str(tmp_path / "none")) == []


def test_cycles_of_a_day_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "days")
    for cycle, times in ((0, 1.0), (1, 1.0), (1, 3.0)):
        sinks.write_days(readings(spark, [0], times).withColumn("cycle", F.lit(cycle)), path, cycle="cycle")
    assert {r["cycle"]: r["kw"] for r in sinks.read_days(spark, path).groupBy("cycle").agg(F.sum("kw").alias("kw")).collect()} == {0: 276.0, 1: 828.0}


def test_a_range_of_days_reads_their_files_only(spark, tmp_path):
    path = str(tmp_path / "days")
    sinks.write_days(readings(spark, range(9)), path)
    got = sinks.read_days(spark, path, start="2026-01-03", end="2026-01-04")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: []" in plan
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "date" in scan
    folders = {f.split("date=")[1][:10] for f in got.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert folders == {"2026-01-03", "2026-01-04"} and got.count() == 48
    metrics = got._jdf.queryExecution().executedPlan()
    files = [n for n in _nodes(metrics) if "FileScan" in n.simpleString(200)]
    files[0].execute()
    assert files[0].metrics().apply("numPartitions").value() == 2


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def test_every_snapshot_file_is_accounted_for(spark, tmp_path):
    good = {"generated_at": "2026-01-01T00:00:00Z", "buildings": {"a": {"kw": 1.0}, "b": {"kw": None}}}
    for name, text in {
        "2026-01-01-00.json": json.dumps(good),
        "2026-01-01-01.json": json.dumps(good, indent=1)[:40],
        "2026-01-01-02.json": "",
        "2026-01-01-03.json": "<html>sorry</html>",
        "2026-01-01-04.json": json.dumps({"generated_at": "2026-01-01T00:00:00Z"}),
        "2026-01-01-05.json": json.dumps(good | {"generated_at": "", "timestamp": None}),
        "2026-01-01-06.json": json.dumps(good | {"generated_at": None, "timestamp": "2026-01-01T06:00:00"}),
        "notes.txt": "not asked for",
    }.items():
        (tmp_path / name).write_text(text)
    path = str(tmp_path)
    rejected = {r["file"]: (r["problem"], r["payload"]) for r in archives.rejected_snapshots(spark, path).collect()}
    assert {f[11:13]: p for f, (p, _) in rejected.items()} == {"01": "unreadable", "02": "empty", "03": "unreadable", "04": "no buildings", "05": "no time"}
    assert rejected["2026-01-01-03.json"][1] == "<html>sorry</html>"
    assert sorted(r["file"][11:13] for r in archives.read_snapshots(spark, path).collect()) == ["00", "06"]
    assert archives.snapshot_buildings(archives.read_snapshots(spark, path)).count() == 4


def test_unreadable_histories_are_told(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"a": [{"kw": 1.0, "ts": "x", "t": "00:00"}]}))
    (tmp_path / "bad.json").write_text('{"a": [')
    (tmp_path / "void.json").write_text(" ")
    path = str(tmp_path / "*.json")
    assert {r["file"]: r["problem"] for r in archives.rejected_histories(spark, path).collect()} == {"bad.json": "unreadable", "void.json": "empty"}
    assert archives.read_history(spark, path).count() == 1
    assert archives.rejected_histories(spark, str(tmp_path / "missing.json")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 10_001])
def test_documents_of_any_size(spark, tmp_path, n):
    path = str(tmp_path / "doc")
    rows = spark.range(n).select(
        F.concat(F.lit('b "quoted" \\ ü'), F.col("id").cast("string")).alias("bid"),
        F.when(F.col("id") % 7 != 0, F.col("id") / 4).alias("kw"), F.lit('x: {"}').alias("name"), F.array(F.lit(1.5), F.lit(None)).alias("line"),
    )
    value = F.struct("kw", "name", "line")
    for _ in range(2):  # written again, the manifest names the new shards
        sinks.write_sharded(rows, path, key="bid", value=value, header=spark.range(1).select(F.lit("now").alias("generated_at")), entries=1000)
    back = sinks.read_sharded(spark, path, "STRUCT<kw DOUBLE, name STRING, line ARRAY<DOUBLE>>").select("bid", "v.*")
    assert back.exceptAll(rows).count() == 0 and back.count() == n
    about = sinks.manifest(spark, path).first()
    assert (about["entries"], about["shards"], about["generated_at"]) == (n, max(1, -(-n // 1000)), "now")


def test_a_cycle_goes_on_from_the_newest_one_before(spark, tmp_path):
    registry = spark.createDataFrame([("hall", 1, "Hall", "M1", ["3"])], "id string, ordinal int, name string, mac string, meters array<string>")
    out = str(tmp_path / "campus")
    for cycle, kw in ((0, 10.0), (1, 20.0), (4, 30.0)):
        at = DAY + timedelta(minutes=cycle)
        load = spark.createDataFrame([("M1", "3", kw, at)], "mac string, meter string, kw double, ts timestamp_ntz")
        jobs.run_cycle(spark, registry, load, out, cycle=cycle, now=str(at))
    assert spark.read.parquet(f"{out}/snapshot/cycle=4").first()["sparkline"] == [10.0, 20.0, 30.0]
    assert [r["day"] for r in archives.read_daily_index(spark, f"{out}/index").collect()] == ["2026-01-01"]


def test_a_campus_of_more_than_a_page_is_sharded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "DOCUMENT_ENTRIES", 3)
    rows = [(f"h{i}", i, f"Hall {i}", f"M{i}", ["3"]) for i in range(7)]
    registry = spark.createDataFrame(rows, "id string, ordinal int, name string, mac string, meters array<string>")
    loads = spark.createDataFrame([(f"M{i}", "3", float(i), DAY) for i in range(7)], "mac string, meter string, kw double, ts timestamp_ntz")
    jobs.run_cycle(spark, registry, loads, str(tmp_path), cycle=0, now=str(DAY))
    back = sinks.read_sharded(spark, f"{tmp_path}/campus_energy_shards", "STRUCT<name STRING, kw DOUBLE>").select("bid", "v.*")
    assert {r["bid"]: r["kw"] for r in back.collect()} == {f"h{i}": float(i) for i in range(7)}
    assert sinks.manifest(spark, f"{tmp_path}/campus_energy_shards").first()["buildings_online"] == 7


def test_all_water_meters_are_kept(spark, tmp_path):
    meters = spark.createDataFrame([("3", 1, "Main", "480 V")], "meter string, ord int, name string, voltage string")
    power = spark.createDataFrame([("3", 0, DAY, "2026-01-01 00:00:00", 5.0)], "meter string, line int, ts timestamp_ntz, local_time string, kw double")
    from wattfold.sources import exports

    blank = {m: F.lit(None).cast("double") for m in exports.POWER_MEASURES if m != "kw"}
    interior = jobs.building_summary(power.withColumns(blank), meters, as_of="2026-01-01 01:00:00")
    flows = [(m, 0, DAY, "2026-01-01 00:00:00", v) for m, v in (("w2", 2.0), ("w1", 1.0), ("w3", 3.0))]
    rows = spark.createDataFrame(flows, "meter string, line int, ts timestamp_ntz, local_time string, water1_rate_cfm double")
    rows = rows.withColumns({m: F.lit(None).cast("double") for m in exports.WATER_MEASURES if m != "water1_rate_cfm"})
    water = jobs.water_summary(rows, as_of="2026-01-01 01:00:00")
    doc = jobs.interior_document(interior, generated_at="now", building={"id": "x"}, water=water)
    sinks.write_document(doc, str(tmp_path / "doc"))
    got = {r["meter"]: r["latest"]["water1_rate_cfm"] for r in archives.read_interior_water(spark, str(tmp_path / "doc")).collect()}
    assert got == {"w1": 1.0, "w2": 2.0, "w3": 3.0}
    assert archives.read_interior_summary(spark, str(tmp_path / "doc")).first()["meters_online"] == 1
    assert spark.read.schema(archives.INTERIOR_SCHEMA).json(str(tmp_path / "doc")).first()["water"]["latest"]["water1_rate_cfm"] == 1.0
