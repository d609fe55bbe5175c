"""Recorded stores against what the operators make of them.

Set WATTFOLD_GOLDEN to a directory with daily/, archive/ and weekly_report.json.
Figures are compared digit for digit, without a tolerance.
"""

import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from wattfold.operators import baselines as base
from wattfold.operators import rolling
from wattfold.plans import jobs
from wattfold.sources import archives

GOLDEN = os.environ.get("WATTFOLD_GOLDEN")
pytestmark = pytest.mark.skipif(not GOLDEN, reason="WATTFOLD_GOLDEN is not set")


@pytest.fixture(scope="module")
def daily(spark):
    return archives.read_daily(spark, f"{GOLDEN}/daily").cache()


@pytest.fixture(scope="module")
def snaps(spark):
    return archives.read_snapshots(spark, f"{GOLDEN}/archive").cache()


@pytest.fixture(scope="module")
def report(spark):
    return archives.read_report(spark, f"{GOLDEN}/weekly_report.json").cache()


@pytest.fixture(scope="module")
def week(spark):
    rows = archives.read_daily(spark, f"{GOLDEN}/daily", start="2026-05-26", end="2026-06-01")
    return jobs.weekly_report(rows, archives.building_readings(rows), as_of="2026-06-01")


def test_scan_sizes(spark, daily, snaps):
    assert daily.count() == 802
    assert daily.select("date").distinct().count() == 53
    assert archives.building_readings(daily).count() == 20850
    assert archives.snapshot_buildings(snaps).select(F.explode("sparkline")).count() == 12896
    assert archives.read_daily_index(spark, f"{GOLDEN}/daily/index.json").count() == 53


def test_campus_totals_follow_from_buildings(daily):
    from wattfold.operators.rollups import campus_readings

    again = campus_readings(archives.building_readings(daily)).withColumnRenamed("total_kw", "again")
    joined = daily.join(again.withColumnRenamed("online", "online_again"), "ts")
    assert joined.count() == 802
    assert joined.filter((F.col("total_kw") != F.col("again")) | (F.col("online") != F.col("online_again"))).count() == 0


def test_weekly_days(report, week):
    want = [r.asDict() for r in report.select(F.inline("daily_breakdown")).orderBy("date").collect()]
    got = [{**r.asDict(), "date": str(r["date"])} for r in week.days.orderBy("date").collect()]
    assert got == want


def test_weekly_buildings(report, week):
    want = {r["key"]: r["value"].asDict() for r in report.select(F.explode("building_rankings")).collect()}
    got = {r["bid"]: {k: v for k, v in r.asDict().items() if k != "bid"} for r in week.buildings.collect()}
    assert got == want


def test_weekly_campus(report, week):
    want = report.select("campus_summary.*", F.col("period.days"), F.col("period.total_readings")).first().asDict()
    got = week.campus.first().asDict()
    assert {k: got[k] for k in want} == want
    document = jobs.report_document(week, generated_at="x").first()
    assert document["campus_summary"]["avg_kw"] == want["avg_kw"]
    assert len(document["daily_breakdown"]) == 7 and len(document["building_rankings"]) == 26


def sparkline_readings(snaps):
    """Sparklines as histories: one key per snapshot and building."""
    rows = archives.snapshot_buildings(snaps).select(F.concat_ws("|", "file", "bid").alias("bid"), F.posexplode("sparkline"))
    at = F.lit("2026-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("pos"))
    return rows.select("bid", at.alias("ts"), F.col("pos").cast("bigint").alias("seq"), F.col("col").alias("kw"))


def test_forecast_and_anomaly(snaps):
    judged = jobs.judge_history(sparkline_readings(snaps))
    want = archives.snapshot_buildings(snaps).select(
        F.concat_ws("|", "file", "bid").alias("bid"),
        F.col("predicted_kw").alias("want_kw"), F.col("anomaly").alias("want_anomaly"), "kw", "sparkline"
    )
    judged = judged.withColumnRenamed("sparkline", "got_sparkline")
    rows = want.join(judged, "bid", "left").withColumn("anomaly", F.when(F.col("kw").isNotNull(), F.col("anomaly"))).collect()
    assert len(rows) == 798
    assert [r["bid"] for r in rows if r["predicted_kw"] != r["want_kw"]] == []
    assert [r["bid"] for r in rows if r["anomaly"] != r["want_anomaly"]] == []
    assert sum(r["want_anomaly"] is not None for r in rows) == 5
    assert [r["bid"] for r in rows if (r["got_sparkline"] or []) != r["sparkline"]] == []


def test_estimates(snaps):
    from wattfold.operators.latest import with_estimates

    cols = ["status", "est_daily_kwh", "est_daily_cost", "est_daily_co2_kg"]
    rows = archives.snapshot_buildings(snaps).select("kw", F.struct(*cols).alias("want"))
    got = with_estimates(rows).select("want", F.struct(*cols).alias("got"))
    assert got.filter("NOT (want <=> got)").count() == 0


def test_headers(snaps):
    heads = snaps.select("file", "buildings_total", "buildings_online", "total_kw", "total_daily_kwh", "total_daily_cost",
                         "total_daily_co2_kg", "anomaly_count").collect()
    for head in heads:
        rows = archives.snapshot_buildings(snaps.filter(F.col("file") == head["file"]))
        got = jobs.snapshot_header(rows, now="").first()
        assert {k: head[k] for k in head.asDict() if k != "file"} == {k: got[k] for k in head.asDict() if k != "file"}


def test_histories_give_sparklines(daily, snaps):
    """The last 24 archived readings up to a snapshot are its sparkline (the first snapshot is older than
    the archive). A reading is stamped when its cycle ends, minutes after the snapshot's time."""
    readings = archives.building_readings(daily).withColumn("seq", F.lit(0).cast("bigint"))
    exact = 0
    for file, at in [(r["file"], r["snap_ts"]) for r in snaps.select("file", "snap_ts").collect()]:
        got = rolling.sparkline(readings.filter(F.col("ts") <= F.lit(at + timedelta(minutes=5))))
        want = archives.snapshot_buildings(snaps.filter(F.col("file") == file)).filter(F.size("sparkline") > 0)
        joined = want.select("bid", F.col("sparkline").alias("want")).join(got, "bid", "left")
        exact += joined.filter("NOT (want <=> sparkline)").count() == 0
    assert exact == 20


def test_baselines_compat(snaps):
    cells = base.baselines(jobs.snapshot_samples(snaps, compat=True)).cache()
    cover = base.coverage(cells).collect()
    assert len(cover) == 26
    assert {(r["samples"], r["tier1_cells"], r["tier2_cells"], r["tier3_cells"]) for r in cover} == {(496, 47, 14, 7)}
    tier4 = {r["bid"]: (r["mean"], r["std"]) for r in cells.filter("tier = 4").collect()}
    small = [b for b, stat in tier4.items() if stat == (17.65, 17.26)]
    assert small and (377.01, 31.54) in tier4.values()
    hours = cells.filter((F.col("tier") == 3) & F.col("bid").isin(small) & (F.col("hr") == 20)).collect()
    assert (13.04, 14.06, 84) in {(h["mean"], h["std"], h["n"]) for h in hours}
    doc = jobs.baseline_document(cells, generated_at="x", files=archives.source_files(snaps)).first()
    assert len(doc["buildings"]) == 26 and len(doc["_source_files"]) == 21


def test_shared_device(daily):
    """Two buildings on one meter report the same load in 794 of 802 readings."""
    loads = archives.building_readings(daily)
    same = loads.groupBy("ts", "kw").agg(F.sort_array(F.collect_list("bid")).alias("ids"))
    pairs = same.filter(F.size("ids") == 2).groupBy("ids").count()
    first, second = pairs.orderBy(F.desc("count")).first()["ids"]
    a, b = (loads.filter(F.col("bid") == i).select("ts", F.col("kw").alias(n)) for i, n in ((first, "a"), (second, "b")))
    assert a.join(b, "ts").filter("a = b").count() == 794
