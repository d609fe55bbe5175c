"""Comfort votes: tallies, shares, recent feed, cooldown."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattfold.functions.rounding import half_up
from wattfold.operators.hotkeys import HOT_ROWS, SEGMENT, global_rank, has_hot_keys, join_same, with_segments
from wattfold.session import scratch_path

# Vote window and pause between two votes of one voter.
VOTE_HOURS, PAUSE_MINUTES, RECENT_VOTES = 2, 10, 15


def _count(vote: str) -> Column:
    return F.count(F.when(F.col("vote") == vote, 1))


def comfort_status(hot: Column, ok: Column, cold: Column) -> Column:
    """Own rule (only the three values are given): a strict plurality decides, else ok."""
    return (
        F.when((hot > ok) & (hot > cold), "too_hot").when((cold > ok) & (cold > hot), "too_cold").otherwise("ok")
    )


def vote_tally(
    votes: DataFrame,
    *,
    as_of: str | None = None,
    hours: int = VOTE_HOURS,
    by: Sequence[Column | str] = ("building",),
) -> DataFrame:
    """hot, ok, cold, total and status per building, over the ``hours`` up to ``as_of``.

    Without ``as_of`` all votes count; add a time window to ``by`` for a tally per period.
    """
    if as_of is not None:
        end = F.lit(as_of).cast(votes.schema["ts"].dataType)
        votes = votes.filter((F.col("ts") > end - F.make_dt_interval(hours=F.lit(hours))) & (F.col("ts") <= end))
    tally = votes.groupBy(*by).agg(
        _count("hot").alias("hot"), _count("ok").alias("ok"), _count("cold").alias("cold"),
        F.count(F.lit(1)).alias("total"),
    )
    return tally.withColumn("status", comfort_status(F.col("hot"), F.col("ok"), F.col("cold")))


def vote_overview(tally: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    return tally.groupBy(*by).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_votes"),
        F.count(F.lit(1)).alias("buildings"),
        F.count(F.when(F.col("status") == "too_hot", 1)).alias("hot_buildings"),
        F.count(F.when(F.col("status") == "too_cold", 1)).alias("cold_buildings"),
    )


def vote_shares(tally: DataFrame, *, whole: bool = True) -> DataFrame:
    """hot and ok in percent (whole numbers or unrounded), cold as what is left of 100."""
    def pct(part: str) -> Column:
        share = f"{part} / total * 100D"
        return F.when(F.col("total") > 0, half_up(share) if whole else F.expr(share)).otherwise(0.0)

    return tally.withColumns({"hot_pct": pct("hot"), "ok_pct": pct("ok")}).withColumn(
        "cold_pct", F.lit(100.0) - F.col("hot_pct") - F.col("ok_pct")
    )


def recent_votes(votes: DataFrame, tally: DataFrame, *, n: int = RECENT_VOTES) -> DataFrame:
    """Latest n votes of the building with the most votes (a scalar subquery, then a top-n)."""
    top = tally.select(F.max_by("building", F.struct("total", "building"))).scalar()
    return votes.filter(F.col("building") == top).orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def rank_by_votes(tally: DataFrame, *, by: str = "building") -> DataFrame:
    """Buildings by number of votes, most first, with ``rank`` from 1; equal numbers in order of the building."""
    return global_rank(tally, order=[F.desc("total"), F.col(by)])


# --- cooldown -------------------------------------------------------------------------
# A vote counts if the voter's last counted vote is at least a pause away. That is a
# recurrence, so one voter's votes depend on each other from the first to the last.
# Ordinary voters are walked from first to last vote. The votes of a hot voter are cut into
# segments that are worked on in parallel:
#   1. per segment a step table: for every vote that could be the first one counted there,
#      the last one that would then be counted (equal outcomes merged);
#   2. the tables of neighbours are composed pairwise, level by level, to the top of a tree;
#      down the tree again, each node learns when the pause it is entered with ends. No task
#      sees more than two tables;
#   3. per segment, the counted votes from there.
# A table covers the votes within the first pause of its node, whatever the node's length.


def _reach(ts: np.ndarray, pause: int) -> np.ndarray:
    """Index of the first vote at least a pause after each vote."""
    return np.searchsorted(ts, ts + pause, side="left")


def counted(ts: np.ndarray, pause: int, free_from: int) -> np.ndarray:
    """Marks the counted votes of sorted ``ts`` when the voter is free from ``free_from`` on."""
    marks = np.zeros(len(ts), dtype=bool)
    i = int(np.searchsorted(ts, free_from, side="left"))
    while i < len(ts):
        marks[i] = True
        i = int(np.searchsorted(ts, ts[i] + pause, side="left"))
    return marks


def _merged(upto: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.append(last[1:] != last[:-1], True)
    return upto[keep], last[keep]


def _outcomes(ts: np.ndarray, pause: int) -> tuple[np.ndarray, np.ndarray]:
    """Step table of a segment: entering at or before ``upto[k]`` ends with ``last[k]`` counted."""
    n = len(ts)
    jump = _reach(ts, pause)
    end = np.arange(n)
    while True:  # doubling: after r rounds every vote has moved 2**r counted votes on
        move = jump < n
        if not move.any():
            break
        to = np.where(move, jump, 0)
        end = np.where(move, end[to], end)
        jump = np.where(move, jump[to], n)
    entries = int(np.searchsorted(ts, ts[0] + pause, side="left")) + 1
    return _merged(ts[:entries], ts[end[:entries]])


def _composed(first: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], pause: int) -> tuple[np.ndarray, np.ndarray]:
    """The step table of two neighbours; ``first`` is the time of the earlier one's first vote."""
    (upto, last), (upto2, last2) = a, b
    at = np.searchsorted(upto2, last + pause, side="left")
    last = np.where(at < len(upto2), last2[np.minimum(at, len(upto2) - 1)], last)
    # a pause that outlasts the earlier node is entered into the later one
    more = slice(int(np.searchsorted(upto2, upto[-1], side="right")), int(np.searchsorted(upto2, first + pause, side="left")) + 1)
    return _merged(np.append(upto, upto2[more]), np.append(last, last2[more]))


def cooldown(
    votes: DataFrame,
    *,
    by: Sequence[str] = ("voter",),
    ts: str = "ts",
    seq: str = "seq",
    minutes: float = PAUSE_MINUTES,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Adds ``accepted``: true for the votes that count under the pause. A vote without a time never counts.

    Voters (for hot ones, their segments) lie sorted one after the other in a partition and
    are walked in Arrow batches, so no group is held in memory.
    """
    by = list(by)
    pause = int(minutes * 60 * 1_000_000)
    timed = votes.where(F.col(ts).isNotNull())
    stamped = timed.withColumn("_us", _micros(timed, ts))
    if has_hot_keys(votes, by, hot_rows):
        stamped = with_segments(stamped, by=by, order=[ts, seq], hot_rows=hot_rows)
        stamped = join_same(stamped, _segment_entries(stamped, by, pause), [*by, SEGMENT], "left")
    else:
        empty = F.lit(None).cast("bigint")
        stamped = stamped.withColumns({SEGMENT: empty, "_free": empty})

    schema = T.StructType([*votes.schema.fields, T.StructField("accepted", T.BooleanType())])
    keys = [*by, SEGMENT]

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, free = None, 0
        for rows in batches:
            us, entry = rows["_us"].to_numpy(dtype="int64"), rows["_free"].fillna(_NEVER).to_numpy(dtype="int64")
            marks = np.zeros(len(rows), dtype=bool)
            named = rows[keys].astype(object).where(rows[keys].notna(), None)
            new = np.append(True, (named.ne(named.shift()) & ~(named.isna() & named.shift().isna())).any(axis=1).to_numpy()[1:])
            starts = np.flatnonzero(new).tolist()
            for begin, end in zip(starts, [*starts[1:], len(rows)], strict=True):
                key = tuple(named.iloc[begin])
                if key != last:
                    last, free = key, int(entry[begin])
                run = counted(us[begin:end], pause, free)
                if run.any():
                    free = int(us[begin:end][run][-1]) + pause
                marks[begin:end] = run
            yield rows.assign(accepted=marks)[schema.names]

    walked = stamped.repartition(*keys).sortWithinPartitions(*keys, "_us", seq).mapInPandas(mark, schema)
    return walked.unionByName(votes.where(F.col(ts).isNull()).withColumn("accepted", F.lit(False)))


_NEVER = -(1 << 62)


def _micros(df: DataFrame, ts: str) -> Column:
    """Microseconds of a UTC wall-clock; only differences are used."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _segment_entries(stamped: DataFrame, by: Sequence[str], pause: int) -> DataFrame:
    """by, SEGMENT, _free: from when on the voter may vote again in the segment."""
    spark = stamped.sparkSession
    keys = [stamped.schema[c] for c in by]
    table = ["_first", "_upto", "_last"]
    shape = T.StructType([*keys, T.StructField("_node", T.LongType()), *[T.StructField(c, T.LongType()) for c in table]])

    def put(frame: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    def rows(group: pd.DataFrame, first: int, upto: np.ndarray, last: np.ndarray) -> pd.DataFrame:
        head = {c: [group[c].iloc[0]] * len(upto) for c in by}
        return pd.DataFrame({**head, "_node": group["_node"].iloc[0], "_first": first, "_upto": upto, "_last": last})[shape.names]

    def steps(group: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(group["_us"].to_numpy())
        return rows(group, int(times[0]), *_outcomes(times, pause))

    def pair(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_right", "_upto"])
        halves = [(g["_upto"].to_numpy(), g["_last"].to_numpy()) for _, g in group.groupby("_right")]
        first = int(group["_first"].iloc[0])
        return rows(group, first, *(halves[0] if len(halves) == 1 else _composed(first, *halves, pause)))

    segments = stamped.filter(F.col(SEGMENT).isNotNull())
    # One row per segment; its number among the voter's segments is its leaf.
    leaf = F.row_number().over(Window.partitionBy(*by).orderBy(SEGMENT)) - 1
    leaves = put(segments.select(*by, SEGMENT).distinct().withColumn("_node", leaf.cast("bigint")), "pause-leaves")
    votes = join_same(segments.select(*by, SEGMENT, "_us"), leaves, [*by, SEGMENT])
    levels = [put(votes.groupBy(*by, "_node").applyInPandas(steps, shape), "pause-steps")]
    span = leaves.agg(F.coalesce(F.max("_node"), F.lit(0))).first()[0]
    for _ in range(int(span).bit_length()):
        halved = levels[-1].withColumns({"_right": F.col("_node") % 2, "_node": F.floor(F.col("_node") / 2)})
        levels.append(put(halved.groupBy(*by, "_node").applyInPandas(pair, shape), "pause-steps"))
    entries = levels[-1].select(*by, "_node").distinct().withColumn("_free", F.lit(_NEVER))
    for level in reversed(levels[:-1]):
        left = level.where("_node % 2 = 0").withColumn("_parent", F.floor(F.col("_node") / 2)).drop("_node")
        met = join_same(entries.withColumnRenamed("_node", "_parent"), left, [*by, "_parent"])
        fits = F.col("_upto") >= F.col("_free")
        after = F.min_by(F.when(fits, F.col("_last")), F.when(fits, F.col("_upto")))
        met = met.groupBy(*by, "_parent", "_free").agg(after.alias("_after"))
        down = F.array(
            F.struct((F.col("_parent") * 2).alias("_node"), F.col("_free")),
            F.struct((F.col("_parent") * 2 + 1).alias("_node"), F.coalesce(F.col("_after") + pause, F.col("_free")).alias("_free")),
        )
        entries = put(met.select(*by, F.explode(down).alias("_x")).select(*by, "_x.*"), "pause-entries")
    return join_same(leaves, entries, [*by, "_node"]).drop("_node")
