"""Hot keys: the segmented plans give what the plain ones give."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattfold.operators import hotkeys, rolling, rollups, votes


def readings_rows(n=3000, seed=1):
    """A third of the rows on one key, with a burst, a long pause, equal times, zeros and nulls."""
    rng = random.Random(seed)
    at = datetime(2024, 1, 1)
    rows = []
    for seq in range(n):
        key = 0 if rng.random() < 0.34 else rng.randrange(1, 30)
        if seq == n // 2:
            at += timedelta(days=40)
        at += timedelta(seconds=0 if rng.random() < 0.1 else rng.choice([1, 2, 30]) if n // 3 < seq < n // 2 else rng.randrange(1, 900))
        kw = rng.choice([0.0, None]) if rng.random() < 0.08 else rng.randrange(1, 400) / 2
        rows.append((key, at, seq, kw, f"m{key % 3}"))
    return rows


@pytest.fixture(scope="module")
def readings(spark):
    return spark.createDataFrame(readings_rows(), "bid int, ts timestamp_ntz, seq bigint, kw double, meter string").repartition(5).cache()


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("hot", [25, 700])
def test_rolling_anomaly(readings, hot):
    plain = rolling.rolling_anomaly(readings)
    cut = rolling.rolling_anomaly(readings, hot_rows=hot)
    assert rows_of(plain) == rows_of(cut.select(plain.columns))


@pytest.mark.parametrize("hours", [0.5, 30])
def test_time_range(readings, hours):
    plain = rolling.rolling_anomaly(readings, hours=hours)
    cut = rolling.rolling_anomaly(readings, hours=hours, hot_rows=60)
    assert rows_of(plain) == rows_of(cut.select(plain.columns))


@pytest.mark.parametrize("hot", [100])
def test_wma_forecast(readings, hot):
    plain = rolling.wma_forecast(readings)
    cut = rolling.wma_forecast(readings, hot_rows=hot)
    assert rows_of(plain) == rows_of(cut.select(plain.columns))


def test_rolling_matches_brute_force(readings):
    from collections import defaultdict

    history, want = defaultdict(list), {}
    for bid, _, seq, kw, _ in sorted(readings_rows(), key=lambda r: (r[1], r[2])):
        if kw is None:
            continue
        history[bid].append(kw)
        live = [v for v in history[bid][-8:] if v]
        kind = None
        if len(live) >= 4:
            avg = sum(live) / len(live)
            kind = "high" if kw > avg * 1.5 else "low" if avg > 10 and kw < avg * 0.3 else None
        tail = [v for v in history[bid][-4:] if v]
        weights = range(1, len(tail) + 1)
        ahead = round(sum(v * w for v, w in zip(tail, weights)) / sum(weights), 1) if len(tail) >= 2 else None
        want[seq] = (kind, ahead)
    both = rolling.wma_forecast(rolling.rolling_anomaly(readings, hot_rows=50), hot_rows=50)
    assert {r["seq"]: (r["anomaly_type"], r["predicted_kw"]) for r in both.collect()} == want


def test_segments_hold_at_most_hot_rows(readings):
    hot = 40
    whole = hotkeys.with_segments(readings, by=["bid"], order=["ts", "seq"], hot_rows=hot).cache()
    cut = whole.filter(F.col(hotkeys.SEGMENT).isNotNull())
    assert cut.select("bid").distinct().count() >= 1 and whole.count() == readings.count()
    assert cut.groupBy("bid", hotkeys.SEGMENT).count().agg(F.max("count")).first()[0] <= hot
    spans = cut.groupBy("bid", hotkeys.SEGMENT).agg(F.min(F.struct("ts", "seq")).alias("a"), F.max(F.struct("ts", "seq")).alias("b")).orderBy("bid", hotkeys.SEGMENT).collect()
    assert all(x["bid"] != y["bid"] or x["b"] < y["a"] for x, y in zip(spans, spans[1:], strict=False)), "segments ascend"


@pytest.fixture(scope="module")
def odd(spark):
    """A third of the rows within one second, rows without time, without key, and a hot null key."""
    rng = random.Random(9)
    at = datetime(2024, 1, 1)
    rows = []
    for seq in range(1500):
        key = 0 if seq % 3 == 0 else None if seq % 3 == 1 and seq % 2 else rng.randrange(1, 9)
        ts = at + timedelta(microseconds=seq) if key == 0 and seq > 300 else None if rng.random() < 0.05 else at + timedelta(minutes=seq)
        rows.append((key, ts, seq, rng.choice([0.0, None]) if rng.random() < 0.08 else rng.randrange(1, 400) / 2, f"m{seq % 3}"))
    return spark.createDataFrame(rows, "bid int, ts timestamp_ntz, seq bigint, kw double, meter string").repartition(5).cache()


@pytest.mark.parametrize("hot", [30, 200])
def test_bursts_and_nulls_give_the_same(odd, hot):
    for plain, cut in (
        (rolling.rolling_anomaly(odd), rolling.rolling_anomaly(odd, hot_rows=hot)),
        (rolling.wma_forecast(odd), rolling.wma_forecast(odd, hot_rows=hot)),
        (hotkeys.row_position(odd, by=["bid"], order=["ts", "seq"]), hotkeys.row_position(odd, by=["bid"], order=["ts", "seq"], hot_rows=hot)),
        (rolling.rolling_anomaly(odd, hours=2), rolling.rolling_anomaly(odd, hours=2, hot_rows=hot)),
        (votes.cooldown(odd, by=["bid"]), votes.cooldown(odd, by=["bid"], hot_rows=hot)),
    ):
        assert rows_of(plain) == rows_of(cut.select(plain.columns))
    cut = hotkeys.with_segments(odd, by=["bid"], order=["ts", "seq"], hot_rows=hot).filter(F.col(hotkeys.SEGMENT).isNotNull())
    assert cut.groupBy("bid", hotkeys.SEGMENT).count().agg(F.max("count")).first()[0] <= hot
    assert {r["bid"] for r in cut.select("bid").distinct().collect()} >= {0, None}


@pytest.mark.parametrize("hot", [25])
def test_row_position(readings, hot):
    args = {"by": ["bid"], "order": ["ts", "seq"]}
    plain = hotkeys.row_position(readings, **args)
    assert rows_of(plain) == rows_of(hotkeys.row_position(readings, hot_rows=hot, **args))


def test_positional_combine(readings):
    assert rows_of(rollups.combine(readings, positional=True)) == rows_of(rollups.combine(readings, positional=True, hot_rows=50))


@pytest.mark.parametrize("n", [1, 96])
def test_last_n(readings, n):
    want = {}
    for key in {r[0] for r in readings_rows()}:
        last = sorted((r for r in readings_rows() if r[0] == key), key=lambda r: (r[1], r[2]))[-n:]
        want |= {r[2]: r[3] for r in last if r[3] is not None}
    assert {r["seq"]: r["kw"] for r in rolling.last_n(readings, n=n, value="kw").collect()} == want


def test_last_n_is_cut_before_the_shuffle(readings):
    plan = rolling.last_n(readings, n=96)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2, "a partial cut per task, then the final one"


def test_sparkline(readings):
    got = {r["bid"]: r["sparkline"] for r in rolling.sparkline(readings).collect()}
    for key, line in got.items():
        rows = sorted((r for r in readings_rows() if r[0] == key and r[3] is not None), key=lambda r: (r[1], r[2]))
        assert line == [r[3] for r in rows[-24:]]


def test_global_rank_with_many_equal_values(spark, readings):
    rows = readings.select("seq", F.when(F.col("bid") != 0, F.col("kw")).alias("kw"))
    got = hotkeys.global_rank(rows, order=[F.desc(F.coalesce("kw", F.lit(0.0))), F.col("seq")]).collect()
    order = sorted(((-(r[3] or 0.0) if r[0] != 0 else 0.0, r[2]) for r in readings_rows()))
    assert {r["seq"]: r["rank"] for r in got} == {seq: i + 1 for i, (_, seq) in enumerate(order)}


def brute_cooldown(rows, minutes):
    last, out = {}, {}
    for voter, at, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        out[seq] = voter not in last or at - last[voter] >= timedelta(minutes=minutes)
        if out[seq]:
            last[voter] = at
    return out


@pytest.mark.parametrize(("minutes", "hot"), [(1, 150), (10, 20), (600, 20), (600, 150), (10, None)])
def test_cooldown(spark, minutes, hot):
    rows = [(r[0], r[1], r[2]) for r in readings_rows(1500, seed=5)]
    df = spark.createDataFrame(rows, "voter int, ts timestamp_ntz, seq bigint")
    got = votes.cooldown(df, minutes=minutes, **({} if hot is None else {"hot_rows": hot}))
    assert {r["seq"]: r["accepted"] for r in got.collect()} == brute_cooldown(rows, minutes)


def test_pause_of_one_voter_with_very_many_votes(spark):
    """A million votes of one voter, some in bursts; tasks see segments and pairs of step tables."""
    import numpy as np

    rng = np.random.default_rng(3)
    gaps = rng.choice([0, 1, 20_000_000, 4_000_000_000], size=1_000_000, p=[0.5, 0.3, 0.1999, 0.0001])
    times = np.cumsum(gaps)
    frame = spark.range(len(times)).selectExpr("1 voter", "id seq")
    stamps = spark.createDataFrame(__import__("pandas").DataFrame({"seq": np.arange(len(times)), "us": times}))
    df = frame.join(stamps, "seq").selectExpr("voter", "timestamp_micros(us) ts", "seq")
    got = votes.cooldown(df, minutes=1, hot_rows=20_000).filter("accepted").select("seq").toPandas()["seq"].sort_values().tolist()
    want = np.flatnonzero(votes.counted(times, 60_000_000, -1)).tolist()
    assert got == want


@pytest.mark.parametrize("seed", range(40))
def test_step_tables_compose(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    pause = int(rng.integers(1, 30))
    times = np.sort(rng.integers(0, 60, rng.integers(2, 40)))
    cuts = sorted({0, len(times), *rng.integers(1, len(times), rng.integers(0, 5)).tolist()})
    pieces = [times[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    whole = votes._outcomes(pieces[0], pause)
    for piece in pieces[1:]:
        whole = votes._composed(int(times[0]), whole, votes._outcomes(piece, pause), pause)
    for free in range(-1, int(times[0]) + pause + 1):
        marks = votes.counted(times, pause, free)
        at = int(np.searchsorted(whole[0], free))
        last = int(times[marks][-1]) if marks.any() else None
        assert last == (int(whole[1][at]) if at < len(whole[0]) else None)


def test_hot_plan_is_not_taken_for_ordinary_keys(readings):
    assert not hotkeys.has_hot_keys(readings, ["bid"])
    assert hotkeys.has_hot_keys(readings, ["bid"], 100)
