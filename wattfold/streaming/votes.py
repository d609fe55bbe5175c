"""Votes as a stream: sliding tallies and the pause between votes, whatever the micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattfold.operators.votes import PAUSE_MINUTES, VOTE_HOURS, comfort_status, counted, vote_tally
from wattfold.session import scratch_path
from wattfold.streaming.ordered import SLOTS, Clock, Pauses, in_order, run_landed
from wattfold.streaming.commits import BatchStore
from wattfold.streaming.readings import END, LATENESS, cycle_writer

_COUNTS = ("hot", "ok", "cold", "total")


def slot_parts(votes: DataFrame, *, hours: int = VOTE_HOURS, slide: str = "15 minutes") -> DataFrame:
    """Mergeable counts per building and slot of ``hours``, a slot every ``slide``."""
    slot = F.window("ts", f"{hours} hours", slide).alias("w")
    return vote_tally(votes.where("ts is not null"), by=[slot, "building"]).select(F.col("w.start").alias("slot"), "building", *_COUNTS)


def merge_slots(parts: DataFrame) -> DataFrame:
    return parts.groupBy("slot", "building").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def slot_tally(parts: DataFrame) -> DataFrame:
    """Tally per building and slot from the parts of any number of micro-batches."""
    return merge_slots(parts).withColumn("status", comfort_status(F.col("hot"), F.col("ok"), F.col("cold")))


def drop_repeats(votes: DataFrame, *, by: str = "voter", minutes: float = PAUSE_MINUTES) -> DataFrame:
    """Cheap approximation of the pause: repeats of a voter within the watermark are dropped."""
    return votes.withWatermark("ts", f"{int(minutes * 60)} seconds").dropDuplicatesWithinWatermark([by])


def ordered_pauses(
    votes: DataFrame, clock: Clock, *, by: str = "voter", minutes: float = PAUSE_MINUTES, lateness: str = LATENESS, slots: int = SLOTS
) -> DataFrame:
    """(by, ts, seq, accepted) in order of time: the batch operator's answer for votes that come in any order."""
    queue = Pauses(int(minutes * 60 * 1_000_000), counted)
    return in_order(votes, queue, "us BIGINT, seq BIGINT, accepted BOOLEAN", by=by, lateness=lateness, clock=clock, slots=slots)


def replay_cooldown(votes: DataFrame, *, by: str = "voter", **options) -> DataFrame:
    """``ordered_pauses`` over all that has landed."""
    spark = votes.sparkSession
    clock, marks = Clock(spark), scratch_path(spark, "pause-marks")
    marked = ordered_pauses(votes, clock, by=by, **options)
    store = BatchStore(spark, scratch_path(spark, "pauses"), marked.schema)
    write = cycle_writer(store.write)
    run_landed(marked, write, marks)
    clock.strike(END)
    run_landed(marked, write, marks)
    return store.read()
