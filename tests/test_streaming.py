"""Streams over several micro-batches, cut and ordered in any way, against the batch operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattfold.operators import rolling, rollups, votes
from wattfold.streaming import readings as streams
from wattfold.streaming import votes as vote_streams
from wattfold.streaming.commits import BatchStore
from wattfold.streaming.ordered import Clock, TooLate


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    at, out = datetime(2026, 1, 1), []
    for seq in range(900):
        at += timedelta(minutes=rng.randrange(1, 25))
        bid = 1 if rng.random() < 0.4 else rng.randrange(2, 9)
        kw = 0.0 if rng.random() < 0.05 else rng.randrange(1, 3000) / 10
        out.append((bid, at, seq, kw))
    # building 99 stops early and is noticed once the others have moved on
    return out[:40] + [(99, out[39][1], 5000, 50.0), (99, out[39][1] + timedelta(minutes=1), 5001, 70.0)] + out[40:]


WHOLE = "400 days"
VERDICT = ["bid", "ts", "seq", "kw", "anomaly_type", "avg_kw", "ratio", "predicted_kw"]


def land(spark, path, parts):
    for part in parts:
        spark.createDataFrame(part, streams.READING_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture(scope="module")
def landed(spark, rows, tmp_path_factory):
    """Four files, none of them in time order or a span of time of its own."""
    dealt = rows[:]
    random.Random(5).shuffle(dealt)
    return land(spark, str(tmp_path_factory.mktemp("landed")), [dealt[i::4] for i in range(4)])


@pytest.fixture(scope="module")
def in_order(spark, rows, tmp_path_factory):
    size = -(-len(rows) // 3)
    return land(spark, str(tmp_path_factory.mktemp("in_order")), [rows[i * size : (i + 1) * size] for i in range(3)])


@pytest.fixture(scope="module")
def batch(spark, rows):
    return spark.createDataFrame(rows, streams.READING_SCHEMA)


def source(spark, path):
    return streams.read_stream(spark, path, streams.READING_SCHEMA, files_per_trigger=1)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_verdicts_equal_batch_whatever_the_order_of_files(spark, landed, in_order, batch):
    got = streams.replay_verdicts(source(spark, landed), lateness=WHOLE).cache()
    want = rolling.wma_forecast(rolling.rolling_anomaly(batch)).select(VERDICT)
    assert same(got.filter("kw IS NOT NULL").select(VERDICT), want)
    again = streams.replay_verdicts(source(spark, in_order), lateness="1 hour")
    assert same(got, again), "the cut into micro-batches decides nothing"
    silent = [r for r in got.filter("kw IS NULL").collect() if r["bid"] == 99]
    assert [(r["status"], r["seq"], r["predicted_kw"]) for r in silent] == [("offline", 5001, 63.3)]


def plain_silences(rows, registry, hours, until):
    out = set()
    for bid in {r[0] for r in rows} | set(registry):
        times = sorted(([(registry[bid], None)] if bid in registry else []) + [(r[1], r[2]) for r in rows if r[0] == bid and r[1] <= until], key=lambda x: x[0])
        for (at, seq), after in zip(times, [t for t, _ in times[1:]] + [None]):
            end = at + timedelta(hours=hours)
            if end <= until and (after is None or after > end):
                out.add((bid, end, seq))
    return out


def test_silences_of_all_registered_buildings(spark, landed, rows):
    start, until = datetime(2025, 12, 31), datetime(2026, 1, 8)
    registry = {1: start, 99: start, 500: start, 501: start + timedelta(days=3), 502: until}
    frame = spark.createDataFrame(list(registry.items()), "bid long, ts timestamp")
    got = streams.replay_verdicts(source(spark, landed), lateness=WHOLE, until=str(until), offline_hours=3, registry=frame).cache()
    silent = {(r["bid"], r["ts"], r["seq"]) for r in got.filter("kw is null").collect()}
    assert silent == plain_silences(rows, registry, 3, until) and {b for b, _, _ in silent} >= {500, 501}
    assert got.filter("kw is not null").count() == sum(r[1] <= until for r in rows)


def test_late_readings_take_their_place(spark, tmp_path):
    at = datetime(2026, 1, 1)
    parts = [[(1, at, 0, 10.0), (1, at + timedelta(minutes=30), 1, 20.0)], [(1, at + timedelta(minutes=10), 2, 99.0), (1, at + timedelta(minutes=40), 3, 30.0)]]
    path = land(spark, str(tmp_path), parts)
    got = streams.replay_verdicts(source(spark, path)).filter("kw IS NOT NULL").orderBy("ts")
    assert [(r["seq"], r["predicted_kw"]) for r in got.collect()] == [(0, None), (2, 69.3), (1, 44.7), (3, 38.8)]


def test_a_replay_does_not_lose_rows_silently(spark, tmp_path):
    at = datetime(2026, 1, 1)
    path = land(spark, str(tmp_path), [[(1, at + timedelta(days=2), 0, 10.0)], [(1, at + timedelta(days=2), 1, 10.0)], [(1, at, 2, 20.0)]])
    with pytest.raises(TooLate, match="1 rows"):
        streams.replay_verdicts(source(spark, path))


def test_readings_without_time_load_or_building(spark, tmp_path):
    at = datetime(2026, 1, 1)
    path = land(spark, str(tmp_path), [[(None, at, 0, 10.0), (1, None, 1, 20.0)], [(1, at, 2, None), (None, at + timedelta(minutes=1), 3, 30.0)]])
    got = streams.replay_verdicts(source(spark, path)).filter("kw IS NOT NULL").orderBy("ts").collect()
    assert [(r["bid"], r["seq"], r["predicted_kw"]) for r in got] == [(None, 0, None), (None, 3, 23.3)]


def test_a_released_backlog_is_not_broadcast(spark, landed, monkeypatch):
    """The last micro-batch reads a tick of the clock and hands on all readings: its size as Spark sees it says nothing."""
    plans, judge = [], streams.judge

    def seen(batch, **options):
        made = judge(batch, **options)
        assert batch.storageLevel.useDisk and not batch.storageLevel.useMemory
        plans.append((batch.count(), made._jdf.queryExecution().executedPlan().toString()))
        return made

    monkeypatch.setattr(streams, "judge", seen)
    got = streams.replay_verdicts(source(spark, landed), lateness=WHOLE)
    assert got.filter("kw is not null").count() == 902 <= plans[-1][0] and got.filter("kw is null").count() > 0
    assert all("SortMergeJoin" in plan and "Broadcast" not in plan for _, plan in plans)


def test_history_is_held_in_state(spark, landed, batch, tmp_path):
    marks = str(tmp_path / "marks")
    streams.replay_verdicts(source(spark, landed), lateness=WHOLE, keep=10, marks=marks)
    want = rolling.last_n(batch, n=10).select("bid", "ts", "seq", "kw")
    assert same(streams.held_history(spark, marks), want)


def test_day_totals_equal_batch(spark, landed, batch):
    store = streams.replay_parts(source(spark, landed), streams.day_parts)
    want = rollups.series_stats(batch.filter("kw <> 0").withColumn("day_start", F.date_trunc("day", "ts")), by=["day_start", "bid"])
    for merged in (False, True):
        if merged:
            store.merge(streams.merge_days)
            assert store.attempts().count() == 1
        got = streams.day_totals(store.read())
        both = got.join(want, ["day_start", "bid"])
        assert both.count() == want.count() == got.filter("readings > 0").count()
        assert both.filter((F.col("readings") != F.col("count")) | (F.col("peak_kw") != F.col("max"))).count() == 0
    before = sorted(map(repr, got.collect()))
    store.vacuum()
    assert sorted(map(repr, streams.day_totals(store.read()).collect())) == before


def vote_source(spark, path):
    vote = F.element_at(F.array(F.lit("hot"), F.lit("ok"), F.lit("cold")), (F.pmod("seq", F.lit(3)) + 1).cast("int"))
    return source(spark, path).select(F.concat(F.lit("b"), "bid").alias("building"), F.col("bid").alias("voter"), "ts", "seq", vote.alias("vote"))


def test_cooldown_equals_batch_on_shuffled_files(spark, landed, batch):
    got = vote_streams.replay_cooldown(vote_source(spark, landed), minutes=90, lateness=WHOLE)
    want = votes.cooldown(batch.select(F.col("bid").alias("voter"), "ts", "seq"), minutes=90)
    cols = ["voter", "seq", "accepted"]
    assert same(got.select(cols), want.select(cols))


def test_sliding_tally(spark, landed, in_order, rows):
    got = vote_streams.slot_tally(streams.replay_parts(vote_source(spark, landed), vote_streams.slot_parts).read())
    # every vote falls into eight windows of two hours that start 15 minutes apart
    assert got.agg(F.sum("total")).first()[0] == 8 * len(rows)
    assert same(got, vote_streams.slot_tally(streams.replay_parts(vote_source(spark, in_order), vote_streams.slot_parts).read()))


def test_repeats_within_the_watermark(spark, in_order, rows):
    got = streams.run_append(vote_streams.drop_repeats(vote_source(spark, in_order), minutes=10), "t-repeats")
    assert len({r[0] for r in rows}) <= got.count() < len(rows)


def test_a_live_job_takes_up_where_it_stopped(spark, rows, tmp_path):
    path, marks = str(tmp_path / "in"), str(tmp_path / "marks")
    clock = Clock(spark, str(tmp_path / "clock"))
    store = streams.verdict_store(spark, str(tmp_path / "out"), T.StructField("bid", T.LongType()))
    for part in (rows[:450], rows[450:]):
        land(spark, path, [part])
        job = streams.start_verdicts(source(spark, path), clock, store, marks=marks, every="0 seconds", lateness="1 hour")
        job.processAllAvailable()
        job.stop()
    seen = store.read().filter("kw is not null").count()
    edge = rows[-1][1] - timedelta(hours=1)
    assert sum(r[1] < edge for r in rows) - 1 <= seen <= len(rows) and seen == store.read().filter("kw is not null").select("seq").distinct().count()


def test_cycle_writer_repeats_do_not_add(spark, landed, tmp_path):
    schema = T.StructType([T.StructField("bid", T.LongType()), T.StructField("ts", T.TimestampType())])
    store = BatchStore(spark, str(tmp_path / "cycles"), schema)
    assert store.read().count() == 0
    write = streams.cycle_writer(lambda df, i: store.write(df.groupBy("bid").agg(F.max("ts").alias("ts")), i))
    frame = spark.read.parquet(landed)
    write(frame, 0)
    write(frame, 0)
    assert store.read().count() == frame.select("bid").distinct().count()
    store.vacuum()
    assert store.read().count() == frame.select("bid").distinct().count()


def test_a_batch_that_fails_half_way_leaves_one_copy(spark, landed, tmp_path, monkeypatch):
    """The rows are written, the commit is not; the stream repeats the batch after a restart."""
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    store = BatchStore(spark, out, T._parse_datatype_string(streams.READING_SCHEMA))
    put, tries = BatchStore._put, []

    def fails_once(self, frame, kind, batch_id):
        tries.append(batch_id)
        if batch_id == 1 and tries.count(1) == 1:
            frame.write.parquet(f"{out}/rows/attempt=lost")
            raise RuntimeError("lost on the way")
        put(self, frame, kind, batch_id)

    monkeypatch.setattr(BatchStore, "_put", fails_once)
    with pytest.raises(Exception, match="lost on the way"):
        streams.replay_parts(source(spark, landed), lambda df: df, marks=marks, store=store)
    streams.replay_parts(source(spark, landed), lambda df: df, marks=marks, store=store)
    assert tries == [0, 1, 1, 2, 3]
    assert same(store.read(), spark.read.parquet(landed))
    store.vacuum()
    assert spark.read.parquet(f"{out}/rows").select("attempt").distinct().count() == 4


def test_tables_of_part_files_are_streamed(spark, sf_dir, tmp_path):
    from wattfold.plans import queries

    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for made in (queries._event_stream(spark, sf_dir), queries._event_stream(spark, str(tmp_path))):
        assert streams.run_append(made, "t-parts").count() == spark.read.parquet(f"{sf_dir}/events.parquet").count() > 0


def test_state_is_kept_by_slot_whatever_the_number_of_keys(spark, tmp_path):
    """Keys without order among them, text and null as well as numbers beyond the whole doubles, in three slots."""
    at, high = datetime(2026, 1, 1), (1 << 53) + 1
    rows = [(high + k % 400 if k % 400 else None, at + timedelta(minutes=k), k, float(k % 17)) for k in range(2000)]
    path = land(spark, str(tmp_path / "in"), [rows[1::2], rows[::2]])
    for kind in ("long", "string"):
        stream, marks = source(spark, path).withColumn("bid", F.col("bid").cast(kind)), str(tmp_path / f"marks-{kind}")
        got = streams.replay_verdicts(stream, lateness=WHOLE, marks=marks, keep=3, slots=3).filter("kw is not null")
        frame = spark.createDataFrame(rows, streams.READING_SCHEMA).withColumn("bid", F.col("bid").cast(kind))
        assert same(got.select(VERDICT), rolling.wma_forecast(rolling.rolling_anomaly(frame)).select(VERDICT))
        held = spark.read.format("statestore").option("stateVarName", "past").option("flattenCollectionTypes", True).load(marks)
        assert held.select("key.slot").distinct().count() == 3
        assert same(streams.held_history(spark, marks, kind=kind), rolling.last_n(frame, n=3).select("bid", "ts", "seq", "kw"))


def test_a_landing_of_several_files_is_one_micro_batch(spark, sf_dir):
    from wattfold.plans import queries

    width = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        stream, _ = queries._landed_readings(spark, sf_dir, queries.QUARTERS)
        store = streams.replay_parts(stream, lambda rows: rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", width)
    assert store.attempts().count() == len(queries.QUARTERS)
    assert store.read().count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
