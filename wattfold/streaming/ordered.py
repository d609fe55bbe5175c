"""Rows of a stream in the order of their event time, whatever order they arrive in.

A keyed queue holds rows until the watermark has passed them, then hands them on sorted. As the watermark promises that
nothing older comes any more, what is handed on does not depend on how the input was cut into micro-batches. ``lateness``
bounds the disorder and with it the state; a replay that meets older rows than that fails instead of losing them.

A stream without new rows has no progress of event time. ``clock`` rows, a second source, move it on: a replay ends with
one (``Clock.strike``), and a live job may strike once a cycle, which is also what finds silent keys.

Keys are dealt to ``SLOTS`` slots by a hash. A slot is what Spark calls a key: its rows lie in RocksDB list state, as Arrow
batches that are appended without being read, one timer waits for its oldest row, and the rows that are due are handed on
for all keys of the slot at once. A task holds one slot at a time, so ``slots`` bounds its memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from wattfold.session import scratch_path

CLOCK = "_clock"
#: Slots of a queue, and rows of a batch in its state.
SLOTS, PIECE = 256, 50_000
_KINDS = {"BIGINT": "int64", "DOUBLE": "float64", "BOOLEAN": "bool", "STRING": "object"}
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TooLate(ValueError):
    """Rows came later than ``lateness`` allows."""


class Clock:
    """A folder of times that move a stream's event time on."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or scratch_path(spark, "clock")
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)

    def strike(self, at: str) -> None:
        self.spark.range(1).select(F.lit(at).cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(self.path)

    def beside(self, stream: DataFrame) -> DataFrame:
        """The stream's rows and the clock's, told apart by CLOCK."""
        ticks = self.spark.readStream.schema("ts TIMESTAMP").parquet(self.path).withColumn(CLOCK, F.lit(True))
        return stream.withColumn(CLOCK, F.lit(False)).unionByName(ticks, allowMissingColumns=True)


def pieces(frame: pd.DataFrame) -> list[tuple[bytes]]:
    """The frame as values of a list state."""
    made = []
    for at in range(0, len(frame), PIECE):
        batch, sink = pa.RecordBatch.from_pandas(frame.iloc[at : at + PIECE], preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        made.append((sink.getvalue().to_pybytes(),))
    return made


def piece(value: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(value))).read_all()


def ends(frame: pd.DataFrame) -> np.ndarray:
    """Marks the last row of each key of a sorted frame."""
    none, key = frame["none"].to_numpy(), frame["key"].to_numpy()
    return np.append((none[1:] != none[:-1]) | (key[1:] != key[:-1]), True)[: len(frame)]


def from_end(frame: pd.DataFrame) -> np.ndarray:
    """How many rows of the same key follow each row of a sorted frame."""
    at, rows = np.flatnonzero(ends(frame)), np.arange(len(frame))
    return at[np.searchsorted(at, rows)] - rows


class Queue(StatefulProcessor):
    """Holds rows until the watermark passes their time ``us`` (microseconds, the first of ``fields``).

    Rows of a slot are told apart by ``key`` and by ``none``, which marks those without a key.
    """

    def __init__(self, fields: dict[str, str]) -> None:
        self.fields, self.kind = fields, "BIGINT"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows BINARY")
        self.alarm = handle.getValueState("alarm", "ms BIGINT")

    def held(self, state, fields: dict[str, str]) -> pd.DataFrame:
        """The rows of a list state."""
        whole = {"none": "BOOLEAN", "key": self.kind} | fields
        rows = [piece(value[0]).to_pandas() for value in state.get()] if state.exists() else []
        if rows:
            return pd.concat(rows, ignore_index=True)
        return pd.DataFrame({c: pd.Series(dtype=_KINDS[kind]) for c, kind in whole.items()})

    def hold(self, state, rows: pd.DataFrame) -> None:
        if len(rows):
            state.put(pieces(rows))
        elif state.exists():
            state.clear()

    def wake_at(self, us: int) -> None:
        """A timer at the first millisecond by which ``us`` is over, unless one goes off earlier."""
        ms = -(-us // 1000)
        alarm = self.alarm.get()
        if alarm is None or ms < alarm[0]:
            self.handle.registerTimer(ms)
            self.alarm.update((ms,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if key[-1]:  # the clock
            return
        first = None
        for frame in rows:
            if len(frame):
                least = int(frame["us"].min())
                first = least if first is None else min(first, least)
                self.waiting.appendList(pieces(frame[["none", "key", *self.fields]]))
        if first is not None:
            self.wake_at(first)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self.alarm.clear()
        rows = self.held(self.waiting, self.fields)
        over = rows["us"].to_numpy() <= now
        due, left = rows[over], rows[~over]
        if len(due):
            self.hold(self.waiting, left)
        if len(left):
            self.wake_at(int(left["us"].min()))
        for made in self.release(due.sort_values(["none", "key", *self.fields], ignore_index=True), now):
            for at in range(0, len(made), PIECE):
                yield made.iloc[at : at + PIECE]

    def release(self, due: pd.DataFrame, now: int) -> Iterator[pd.DataFrame]:
        """What the rows that are due, sorted by key and time, become. Called without rows as well, when a timer goes off."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class Readings(Queue):
    """Readings in order, with what their verdicts need, and a row for each silence.

    Columns: ``role`` is ``reading``, ``lead`` (one of the ``lead`` readings before, handed on again so that row frames
    are whole) or ``silent`` (nothing came for ``pause`` microseconds after ``since``). The last ``keep`` readings stay
    in the state ``past``. A key of the registry that never reports is silent from its first day on.
    """

    #: The last time of a key, whether it is that of the registry (``bare``), and whether the silence after it has been told.
    LAST = {"us": "BIGINT", "seq": "BIGINT", "bare": "BOOLEAN", "told": "BOOLEAN"}

    def __init__(self, lead: int, keep: int, pause: int) -> None:
        super().__init__({"us": "BIGINT", "seq": "BIGINT", "kw": "DOUBLE"})
        self.lead, self.keep, self.pause = lead, keep, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.past = handle.getListState("past", "rows BINARY")
        self.last = handle.getListState("last", "rows BINARY")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        known = pd.concat([self.held(self.last, self.LAST)[["none", "key", "us"]], initialState[["none", "key", "us"]]])
        known = known.astype({"none": "bool", "us": "int64"}).groupby(["none", "key"], as_index=False)["us"].min()
        self.hold(self.last, known.assign(seq=-1, bare=True, told=False))
        self.wake_at(int(known["us"].min()) + self.pause)

    def release(self, due: pd.DataFrame, now: int) -> Iterator[pd.DataFrame]:
        past, last = self.held(self.past, self.fields), self.held(self.last, self.LAST)
        flags = {"bare": False, "told": False}
        line = pd.concat([past.assign(part=0, **flags), last.assign(part=1, kw=np.nan), due.assign(part=2, **flags)], ignore_index=True)
        line = line.sort_values(["none", "key", "part", "us", "seq", "kw"], ignore_index=True)
        if not len(line):
            return
        group, part = np.cumsum(ends(line)), line["part"].to_numpy()  # of a key's rows all but the last have the same number
        group = np.append(0, group[:-1])

        shown = line[part > 0]  # what is known of the last reading, and the new ones
        us, final = shown["us"].to_numpy(), ends(shown)
        pause = np.where(final, us + self.pause <= now, np.append(us[1:], 0)[: len(us)] - us > self.pause)
        pause &= ~shown["told"].to_numpy(dtype=bool)
        state = shown.assign(told=shown["told"].to_numpy(dtype=bool) | pause)[final]
        if len(due) or pause.any():
            self.hold(self.last, state[["none", "key", *self.LAST]])
        open_ = state["us"][~state["told"]]
        if len(open_):
            self.wake_at(int(open_.min()) + self.pause)

        old, seen = line[part == 0], line[part != 1]
        if len(due):
            self.hold(self.past, seen[from_end(seen) < self.keep][["none", "key", *self.fields]])
        told = np.zeros(group[-1] + 1, dtype=bool)  # keys of which something is handed on
        told[group[part > 0][pause | (shown["part"].to_numpy() == 2)]] = True
        leads = old[(from_end(old) < self.lead) & told[group[part == 0]]]
        silent = shown[pause]
        silences = silent.assign(us=silent["us"] + self.pause, seq=silent["seq"].astype("Int64").mask(silent["bare"]), kw=np.nan, since=silent["us"].astype("Int64"))
        empty = pd.array([None], dtype="Int64")
        made = [(leads.assign(since=empty.repeat(len(leads))), "lead"), (due.assign(since=empty.repeat(len(due))), "reading"), (silences, "silent")]
        columns = ["key", "none", "us", "seq", "kw", "role", "since"]
        for frame, role in made:
            if len(frame):
                yield frame.assign(role=role)[columns].astype({"seq": "Int64"})


class Pauses(Queue):
    """Votes in order, each with whether it counts: it does if the voter's last counted vote is a pause away."""

    def __init__(self, pause: int, counted: Callable[[np.ndarray, int, int], np.ndarray]) -> None:
        super().__init__({"us": "BIGINT", "seq": "BIGINT"})
        self.pause, self.counted = pause, counted

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.free = handle.getListState("free", "rows BINARY")

    def release(self, due: pd.DataFrame, now: int) -> Iterator[pd.DataFrame]:
        held = self.held(self.free, {"us": "BIGINT"})
        free = dict(zip(zip(held["none"].tolist(), held["key"].tolist(), strict=True), held["us"].tolist(), strict=True))
        times, marks = due["us"].to_numpy(), np.zeros(len(due), dtype=bool)
        final = ends(due)
        stops, named = (np.flatnonzero(final) + 1).tolist(), due[final]
        names = zip(named["none"].tolist(), named["key"].tolist(), strict=True)
        for name, begin, end in zip(names, [0, *stops][: len(stops)], stops, strict=True):
            run = self.counted(times[begin:end], self.pause, free.get(name, np.iinfo(np.int64).min))
            if run.any():
                marks[begin:end] = run
                free[name] = int(times[begin:end][run][-1]) + self.pause
        left = [(*name, us) for name, us in free.items() if us > now]  # forgotten once no vote can fall into the pause any more
        if free:
            self.hold(self.free, pd.DataFrame(left, columns=["none", "key", "us"]))
        if left:
            self.wake_at(min(us for *_, us in left))
        if len(due):
            yield due.assign(accepted=marks)[["key", "none", "us", "seq", "accepted"]]


def in_order(
    stream: DataFrame, queue: Queue, columns: str, *, by: str, lateness: str, clock: Clock, initial: DataFrame | None = None, slots: int = SLOTS
) -> DataFrame:
    """Runs ``queue`` over the stream (``by``, ts, seq, ...). Rows without a time have no place in event time."""
    whole = isinstance(stream.schema[by].dataType, T.IntegralType)
    kind, queue.kind = stream.schema[by].dataType.simpleString(), "BIGINT" if whole else "STRING"
    blank = F.lit(0 if whole else "").cast(queue.kind)  # tasks read columns into pandas: nulls would make doubles of whole numbers

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("none", F.col("key").isNull()).withColumn("key", F.coalesce(F.col("key").cast(queue.kind), blank))
        return rows.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(slots)).cast("int"))

    payload = [c for c in queue.fields if c not in ("us", "seq")]
    rows = stream.where("ts is not null").select(F.col(by).alias("key"), "ts", "seq", *payload)
    timed = dealt(clock.beside(rows)).withColumns({"us": F.unix_micros("ts"), "seq": F.coalesce("seq", F.lit(-1).cast("bigint"))})
    timed = timed.withWatermark("ts", lateness)
    start = None
    if initial is not None:
        known = initial.select(F.col(by).cast(kind).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.lit(False).alias(CLOCK))
        start = dealt(known).groupBy("slot", CLOCK)
    made = timed.groupBy("slot", CLOCK).transformWithStateInPandas(
        queue, f"key {queue.kind}, none BOOLEAN, {columns}", "Append", "EventTime", **({"initialState": start} if start is not None else {})
    )
    made = made.withColumn("key", F.when(~F.col("none"), F.col("key")).cast(kind)).drop("none")
    times = {"ts": F.timestamp_micros("us")} | ({"since": F.timestamp_micros("since")} if "since" in made.columns else {})
    return made.withColumns(times).drop("us").withColumnRenamed("key", by)


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started here keep their state in RocksDB, which list state and timers need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_landed(stream: DataFrame, write: Callable[[DataFrame, int], None], marks: str) -> None:
    """Takes all that has landed through ``write`` and stops. Fails if rows were too late for their queue."""
    with rocks(stream.sparkSession):
        job = stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(write).start()
    job.awaitTermination()
    late = sum(int(o.numRowsDroppedByWatermark) for p in job.recentProgress for o in p.stateOperators)
    if late:
        raise TooLate(f"{late} rows came later than the watermark allows; set a longer lateness")
