"""Readings as a stream: verdicts in event time, day totals, offline alerts, snapshot cycles.

Nothing here depends on how the input is cut into micro-batches. Verdicts wait until the watermark has passed a reading
(``ordered``) and are then made by the batch operators; totals are partial aggregates per micro-batch, merged when read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wattfold.functions.rounding import exact_parts, half_even, join_parts, truthy
from wattfold.operators import rolling
from wattfold.session import scratch_path
from wattfold.streaming.commits import BatchStore
from wattfold.streaming.ordered import SLOTS, Clock, Readings, in_order, piece, rocks, run_landed

# Fixed value: silent buildings count as offline after this.
OFFLINE_HOURS = 2
#: How late a reading may come, unless the caller says otherwise.
LATENESS = "1 hour"
#: The end of a replay: later than any reading (times go through pandas, which ends in 2262).
END = "2250-01-01 00:00:00"

READING_SCHEMA = "bid BIGINT, ts TIMESTAMP, seq BIGINT, kw DOUBLE"


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, *, glob: str = "*.parquet", files_per_trigger: int = 1000
) -> DataFrame:
    """Landed Parquet files as a stream. ``files_per_trigger`` bounds a micro-batch, and with
    it the rows of one building that one task sees at once."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


# --- verdicts -------------------------------------------------------------------------


def ordered_readings(
    stream: DataFrame,
    clock: Clock,
    *,
    by: str = "bid",
    lateness: str = LATENESS,
    keep: int = rolling.HISTORY_ROWS,
    offline_hours: int = OFFLINE_HOURS,
    registry: DataFrame | None = None,
    slots: int = SLOTS,
) -> DataFrame:
    """(by, ts, seq, kw, role, since): readings in order of time, lead-ins and silences, see ``ordered.Readings``.

    ``registry`` (by, ts: known since) names the buildings that are missed even if they never report. Readings without
    a load are passed over, as in the batch operators.
    """
    queue = Readings(lead=rolling.ANOMALY_ROWS - 1, keep=keep, pause=offline_hours * 3_600_000_000)
    columns = "us BIGINT, seq BIGINT, kw DOUBLE, role STRING, since BIGINT"
    return in_order(stream.where("kw is not null"), queue, columns, by=by, lateness=lateness, clock=clock, initial=registry, slots=slots)


def judge(released: DataFrame, *, by: str = "bid") -> DataFrame:
    """A micro-batch of ``ordered_readings``: each reading with verdict and forecast, and an offline row per silence,
    without a load but with the forecast of the last reading before. The batch operators do the work.

    Spark takes the size of a micro-batch from what came in; what the queue hands on may be a whole backlog that a mere
    tick of the clock released. The join therefore asks for a merge: by that estimate all readings would be broadcast."""
    rows = released.where("role <> 'silent'").drop("since")
    judged = rolling.wma_forecast(rolling.rolling_anomaly(rows, by=[by], hot_rows=None), by=[by], hot_rows=None)
    known = judged.select(F.col(by).alias("_by"), F.col("ts").alias("_ts"), F.col("seq").alias("_seq"), "predicted_kw").hint("merge")
    silent = released.where("role = 'silent'").select(by, "ts", "seq", "since")
    silent = silent.join(known, silent[by].eqNullSafe(F.col("_by")) & (F.col("since") == F.col("_ts")) & (F.col("seq") == F.col("_seq")), "left")
    online = judged.where("role = 'reading'").withColumn("status", F.when(F.col("kw") != 0, "online").otherwise("offline"))
    offline = silent.select(by, "ts", "seq", "predicted_kw", F.lit("offline").alias("status"))
    return online.drop("role").unionByName(offline, allowMissingColumns=True)


def verdict_store(spark: SparkSession, path: str, key: T.StructField) -> BatchStore:
    names = "ts TIMESTAMP, seq BIGINT, kw DOUBLE, anomaly_type STRING, avg_kw DOUBLE, ratio DOUBLE, predicted_kw DOUBLE, status STRING"
    return BatchStore(spark, path, T.StructType([key, *T._parse_datatype_string(names).fields]))


def verdict_writer(store: BatchStore, *, by: str = "bid") -> Callable[[DataFrame, int], None]:
    return cycle_writer(lambda batch, batch_id: store.write(judge(batch, by=by), batch_id))


def replay_verdicts(stream: DataFrame, *, by: str = "bid", until: str = END, marks: str | None = None, **options) -> DataFrame:
    """Verdicts over all that has landed, up to ``until`` on the watermark: the rows of ``judge``."""
    spark = stream.sparkSession
    clock, marks = Clock(spark), marks or scratch_path(spark, "verdict-marks")
    store = verdict_store(spark, scratch_path(spark, "verdicts"), stream.schema[by])
    released = ordered_readings(stream, clock, by=by, **options)
    run_landed(released, verdict_writer(store, by=by), marks)
    lateness = options.get("lateness", LATENESS)
    end = spark.sql(f"select string(timestamp'{until}' + interval '{lateness}' + interval 1 second)").first()[0] if until != END else END
    clock.strike(end)
    run_landed(released, verdict_writer(store, by=by), marks)
    return store.read()


def start_verdicts(stream: DataFrame, clock: Clock, store: BatchStore, *, marks: str, by: str = "bid", every: str = "15 minutes", **options) -> StreamingQuery:
    """The live job. ``clock.strike`` once a cycle finds buildings that fell silent."""
    released = ordered_readings(stream, clock, by=by, **options)
    with rocks(stream.sparkSession):
        writer = released.writeStream.option("checkpointLocation", marks).foreachBatch(verdict_writer(store, by=by))
        return writer.trigger(processingTime=every).start()


def held_history(spark: SparkSession, marks: str, *, by: str = "bid", kind: str = "bigint") -> DataFrame:
    """(by, ts, seq, kw): the last readings per building (of type ``kind``) as the state of a verdict job holds them."""
    reader = spark.read.format("statestore").option("stateVarName", "past").option("flattenCollectionTypes", True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0).to_pylist():
                table = piece(value).select(["key", "none", "us", "seq", "kw"])
                yield from table.set_column(0, "key", table["key"].cast(pa.string())).to_batches()

    held = reader.load(marks).select("list_element.rows").mapInArrow(rows, "key string, none boolean, us long, seq long, kw double")
    building = F.when(~F.col("none"), F.col("key")).cast(kind)
    return held.select(building.alias(by), F.timestamp_micros("us").alias("ts"), "seq", "kw")


# --- day totals -----------------------------------------------------------------------


def day_parts(readings: DataFrame, *, by: str = "bid") -> DataFrame:
    """Mergeable day figures over the loads that count: the mean as sums of exact parts."""
    kw = F.col("kw")
    loaded = truthy(kw)
    sums = [F.expr(f"coalesce(sum({part}) filter (where kw <> 0), 0L)").alias(f"sum{i}") for i, part in enumerate(exact_parts("kw"))]
    return readings.where("ts is not null").groupBy(F.date_trunc("day", "ts").alias("day_start"), by).agg(
        F.count(F.when(loaded, kw)).alias("readings"), *sums, F.max(F.when(loaded, kw)).alias("peak_kw"), F.min(F.when(loaded, kw)).alias("min_kw")
    )


def merge_days(parts: DataFrame, *, by: str = "bid") -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("readings", "sum0", "sum1", "sum2")]
    return parts.groupBy("day_start", by).agg(*sums, F.max("peak_kw").alias("peak_kw"), F.min("min_kw").alias("min_kw"))


def day_totals(parts: DataFrame, *, by: str = "bid") -> DataFrame:
    """Day figures per building from parts of any number of micro-batches."""
    mean = F.expr(f"{join_parts('sum0', 'sum1', 'sum2')} / nullif(readings, 0)")
    days = merge_days(parts, by=by).withColumn("avg_kw", mean)
    return days.select("day_start", by, "readings", half_even("avg_kw", 1).alias("avg_kw"), "peak_kw", "min_kw")


def replay_parts(stream: DataFrame, parts: Callable[[DataFrame], DataFrame], *, marks: str | None = None, store: BatchStore | None = None) -> BatchStore:
    """Partial aggregates of each micro-batch over all that has landed. No state, no watermark: a backlog of any age counts."""
    spark = stream.sparkSession
    if store is None:
        empty = parts(spark.createDataFrame([], stream.schema))
        store = BatchStore(spark, scratch_path(spark, "parts"), empty.schema)
    run_landed(stream, lambda batch, batch_id: store.write(parts(batch), batch_id), marks or scratch_path(spark, "parts-marks"))
    return store


def cycle_writer(run: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: one campus cycle per micro-batch, on the batch operators.

    The batch id names what is written, so a repeated batch replaces its own output.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist(StorageLevel.DISK_ONLY)  # a released backlog may be as large as all that has landed
        try:
            run(rows, batch_id)
        finally:
            rows.unpersist()

    return write


def start_cycles(
    stream: DataFrame, run: Callable[[DataFrame, int], None], *, marks: str, every: str = "15 minutes", once: bool = False
) -> StreamingQuery:
    """Starts the cycles, one per ``every`` (or over all that has landed, then stops)."""
    writer = stream.writeStream.option("checkpointLocation", marks).foreachBatch(cycle_writer(run))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


# --- running streams to their end -----------------------------------------------------


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Runs an append stream over all that has landed and gives back what it wrote."""
    spark = stream.sparkSession
    out, marks = scratch_path(spark, name), scratch_path(spark, f"{name}-marks")
    job = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", marks)
        .trigger(availableNow=True)
        .start(out)
    )
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
