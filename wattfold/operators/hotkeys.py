"""Ordered work on keys that may hold a large part of all rows.

A window partitioned by building puts one building's whole history into one task.
That is right for the many ordinary buildings and wrong for the one that holds a
third of the table. The operators here count rows per key first (one column, map-side
combined, the answer is empty in the usual case) and only for the keys above
``hot_rows`` cut the history into segments, so that several tasks share it:

* a bounded frame (last n rows) gets the n-1 rows before the segment as lead-in rows;
* a running row number is the place in the sorted rows, less the place of the key's first row.

Segments come from a sort of the hot keys' rows over all tasks (ranges of the whole sort key, so neither a burst
within one second nor rows without a time pile up), kept in the shared folder, and a cut of each sorted partition at
``hot_rows`` rows: no segment is larger. Keys are compared null-safe. Results are the same with and without the cut,
whatever the counts say. Pass ``hot_rows=None`` where the input holds few rows per key by construction; then nothing
is counted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wattfold.functions.clock import seconds
from wattfold.session import shared_dir

HOT_ROWS = 5_000_000  # rows of one key that one task sorts without trouble
SEGMENT = "_segment"
_LEAD = "_lead_in"
_KEPT_ANSWERS = 256
_answers: dict[tuple, bool] = {}


def hot_keys(df: DataFrame, by: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows: at most rows / hot_rows of them."""
    return df.groupBy(*by).count().filter(F.col("count") > hot_rows).drop("count")


def has_hot_keys(df: DataFrame, by: Sequence[str], hot_rows: int | None = HOT_ROWS) -> bool:
    """Whether any key is hot. The answer only picks the plan, never the result,
    so it is kept per session for inputs that mean the same."""
    if hot_rows is None:
        return False
    keys = df.select(*by)
    token = (df.sparkSession.sparkContext.applicationId, keys.semanticHash(), hot_rows)
    if token not in _answers:
        if len(_answers) >= _KEPT_ANSWERS:
            _answers.clear()
        _answers[token] = not hot_keys(keys, by, hot_rows).isEmpty()
    return _answers[token]


def join_same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names in which null equals null; the left ones stay."""
    named = right.withColumnsRenamed({c: f"_same_{c}" for c in on})
    same = None
    for c in on:
        test = left[c].eqNullSafe(named[f"_same_{c}"])
        same = test if same is None else same & test
    return left.join(named, same, how).drop(*[f"_same_{c}" for c in on])


def _placed(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Sorts over all tasks; adds _part, the number of the sorted partition, and _row, the place in it from 0.

    A global sort range-partitions on the whole sort key, so equal values do not pile up as long as the key ends in
    something unique. The sorted rows are checkpointed, because the places depend on where the range bounds fell and
    must not be drawn again.
    """
    shared_dir(df.sparkSession)
    stamped = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    # Partition number in the upper bits, row number in the lower 33 bits.
    places = {"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}
    return stamped.withColumns(places).drop("_at")


def _counted_through(placed: DataFrame, name: str) -> DataFrame:
    """Adds the 1-based place in the whole sorted table; what is added up is one count per partition."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_row") + 1).drop("_part", "_row", "_offset")


def _apart(df: DataFrame, by: Sequence[str], hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows of hot keys, and the others."""
    hot = hot_keys(df, by, hot_rows)
    return join_same(df, hot, by, "left_semi"), join_same(df, hot, by, "left_anti")


def with_segments(df: DataFrame, *, by: Sequence[str], order: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds SEGMENT: null for ordinary keys; for hot ones a number that ascends in ``order``, of at most ``hot_rows`` rows."""
    hot, ordinary = _apart(df, by, hot_rows)
    placed = _placed(hot, [F.col(c) for c in (*by, *order)])
    number = F.col("_part") * (1 << 33) + F.floor(F.col("_row") / hot_rows)
    cut = placed.withColumn(SEGMENT, number.cast("bigint")).drop("_part", "_row")
    return ordinary.withColumn(SEGMENT, F.lit(None).cast("bigint")).unionByName(cut)


def _with_time_segments(df: DataFrame, *, by: Sequence[str], ts: str, hot_rows: int, least_seconds: int) -> DataFrame:
    """Adds SEGMENT and _width: for hot keys, spans of time of at least ``least_seconds``, sized by the key's busiest minute."""
    keyed = df.select(*by, seconds(df, ts).alias("_sec"))
    width = (
        join_same(keyed, hot_keys(df, by, hot_rows), by, "left_semi")
        .groupBy(*by, F.floor(F.col("_sec") / 60).alias("_minute"))
        .count()
        .groupBy(*by)
        .agg(F.max("count").alias("_peak"))
        .select(*by, F.greatest(F.lit(least_seconds), F.floor(F.lit(60 * hot_rows) / F.col("_peak"))).alias("_width"))
    )
    return join_same(df, width, by, "left").withColumn(SEGMENT, F.floor(seconds(df, ts) / F.col("_width")))


def _last(items: Column, n: int) -> Column:
    return F.when(F.size(items) <= n, items).otherwise(F.slice(items, -n, n))


def _with_lead_in(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Adds to each segment the n-1 rows that come before it, marked as lead-in.

    Every segment that exists has a row, so the n-1 segments before it are enough to look at.
    """
    rest = [c for c in df.columns if c not in (*by, SEGMENT)]
    row = F.struct((-F.col("_back")).alias("_back"), *rest)
    backwards = Window.partitionBy(*by, SEGMENT).orderBy(*[F.desc(c) for c in order])
    earlier = Window.partitionBy(*by).orderBy(SEGMENT).rowsBetween(-(n - 1), -1)
    lead = (
        df.filter(F.col(SEGMENT).isNotNull())
        .withColumn("_back", F.row_number().over(backwards))
        .filter(F.col("_back") < n)
        .groupBy(*by, SEGMENT)
        .agg(F.array_sort(F.collect_list(row)).alias("_tail"))  # n-1 rows at most
        .withColumn("_before", F.flatten(F.collect_list("_tail").over(earlier)))
        .select(*by, SEGMENT, F.explode(_last(F.col("_before"), n - 1)).alias("_row"))
        .select(*by, SEGMENT, *[F.col("_row")[c].alias(c) for c in rest], F.lit(True).alias(_LEAD))
    )
    return df.withColumn(_LEAD, F.lit(False)).unionByName(lead)


def over_last_rows(
    df: DataFrame,
    *,
    by: Sequence[str],
    order: Sequence[str],
    n: int,
    add: Callable[[DataFrame, WindowSpec], DataFrame],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Applies ``add(frame, window)`` where the frame looks back at most n-1 rows."""
    if not has_hot_keys(df, by, hot_rows):
        return add(df, Window.partitionBy(*by).orderBy(*order))
    cut = with_segments(df, by=by, order=order, hot_rows=hot_rows)
    out = add(_with_lead_in(cut, by, order, n), Window.partitionBy(*by, SEGMENT).orderBy(*order))
    return out.filter(~F.col(_LEAD)).drop(_LEAD, SEGMENT)


def over_time_range(
    df: DataFrame,
    *,
    by: Sequence[str],
    ts: str,
    span_seconds: int,
    add: Callable[[DataFrame, WindowSpec], DataFrame],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Applies ``add(frame, window)`` where the frame looks back ``span_seconds`` of time.

    The window is ordered by whole seconds. Segments of hot keys are at least a span wide, so
    the lead-in of a segment comes from the one before it.
    """
    clock = df.withColumn("_sec", seconds(df, ts))
    if not has_hot_keys(df, by, hot_rows):
        return add(clock, Window.partitionBy(*by).orderBy("_sec")).drop("_sec")
    cut = _with_time_segments(clock, by=by, ts=ts, hot_rows=hot_rows, least_seconds=span_seconds)
    ends = F.floor((F.col("_sec") + span_seconds) / F.col("_width")) > F.col(SEGMENT)
    lead = cut.filter(ends).withColumn(SEGMENT, F.col(SEGMENT) + 1).withColumn(_LEAD, F.lit(True))
    both = cut.withColumn(_LEAD, F.lit(False)).unionByName(lead)
    out = add(both, Window.partitionBy(*by, SEGMENT).orderBy("_sec"))
    return out.filter(~F.col(_LEAD)).drop(_LEAD, SEGMENT, "_width", "_sec")


def row_position(
    df: DataFrame,
    *,
    by: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """1-based position of a row within its key."""
    if not has_hot_keys(df, by, hot_rows):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    hot, ordinary = _apart(df, by, hot_rows)
    placed = _counted_through(_placed(hot, [F.col(c) for c in (*by, *order)]), "_place")
    start = placed.groupBy(*by).agg(F.min("_place").alias("_first"))  # one row per hot key
    cut = join_same(placed, start, by).withColumn(name, (F.col("_place") - F.col("_first") + 1).cast("bigint"))
    plain = ordinary.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    return plain.select(*df.columns, name).unionByName(cut.select(*df.columns, name))


def first_rows(df: DataFrame, *, by: Sequence[str], order: Sequence[Column], n: int, name: str = "_rank") -> DataFrame:
    """First ``n`` rows per key. Spark cuts to n rows per key before the shuffle, so a hot key is n rows per task."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)


def global_rank(df: DataFrame, *, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based rank over the whole table without bringing it into one task."""
    return _counted_through(_placed(df, order), name)
