"""Mixing sources to target weights by a low-discrepancy schedule.

Sources get their targets (weights, with a limit on repeats). Each source's documents are shuffled by a digest of their
id and laid end to end, and the line is cut into equal blocks of words. The points of a golden-ratio sequence, mapped
through the cumulative slot counts, give a source to each slot of the mix; the slots of a source are ranked, and rank r
takes the source's block r mod n in pass r div n. A document is taken as often as the slots take its words.

Only DataFrame functions are used. Running sums are two-level (sums of buckets first, then within a bucket), so no
source is one task. What passes the driver: the row count and the number of slots.

Defined cases: null texts and texts without words have size 0 and are never taken; a null source is a source, the last
one; repeated rows and ids count as documents of their own; an empty table gives an empty result; columns other than
id, source and text are ignored. Sources themselves are ordered in one task: a weight table, not documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattfold.llm.graph import stored

#: Fixed value: a word is a run without ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
REPEATS = 3
#: A block is a 1024th of its source, but at most so many words.
BLOCKS, BLOCK_WORDS = 1024, 65_536
#: Fixed value: the odd integer nearest to 2^31 divided by the golden ratio; i * GOLDEN mod 2^31 are the points.
GOLDEN, RANGE = 1_327_217_885, 1 << 31
CELLS, RUN = 4096, 1024


def running(frame: DataFrame, key: str, bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the key's rows that come before. Buckets ascend with the order."""
    rows = frame.withColumn("_bucket", bucket).withColumn("_value", value)
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(key, "_bucket").agg(F.sum("_value").alias("_sum"))
    sums = sums.select(key, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(sums, [key, "_bucket"])
    return placed.withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).drop("_bucket", "_value", "_before")


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """For (source, source_size): sid, weight, target and the slots of each source.

    Targets share all words by weight; what a source cannot take in ``repeats`` passes goes to the others by weight.
    In order of limit per weight the limited sources come first, so one running sum finds the level.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sizes.withColumn("sid", F.row_number().over(ordered)).withColumn("weight", F.pmod(F.col("sid") - 1, F.lit(3)).cast("long") + 1)
    sources = sources.withColumn("limit", F.col("source_size") * repeats).withColumn("ratio", F.expr("cast(limit as double) / weight"))
    rising = Window.orderBy("ratio", "sid")
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = (
        sources.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("sharing", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.expr("cast(left as double) / cast(sharing as double)"))
        .withColumn("at", F.row_number().over(rising))
        .withColumn("level", F.min_by("level", F.expr("case when ratio > level then at end")).over(whole))
        .withColumn("target", F.expr("case when ratio > level then weight * level else cast(limit as double) end"))
        .withColumn("block", F.expr(f"greatest(1L, least({BLOCK_WORDS}L, source_size div {BLOCKS}))"))
        .withColumn("slots", F.expr("cast(floor(target / block + 0.5d) as long)"))
        .withColumn("blocks", F.expr("(source_size + block - 1) div block"))
    )
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    return sources.withColumn("hi", F.sum("slots").over(upto)).withColumn("lo", F.expr("hi - slots"))


def schedule(sources: DataFrame, n_slots: int, repeats: int = REPEATS) -> DataFrame:
    """The mix in order: (slot, sid, epoch, block_no). A range join by cells of equal width, ranks by running counts."""
    spark = sources.sparkSession
    width = max(1, n_slots // CELLS)
    ranges = sources.where("slots > 0").select(
        "sid", "lo", "hi", "blocks", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("cell")
    )
    points = spark.range(n_slots).selectExpr("id slot", f"((id % {RANGE}) * {GOLDEN} % {RANGE}) * {n_slots} div {RANGE} place")
    points = points.withColumn("cell", F.expr(f"place div {width}"))
    chosen = points.join(ranges, "cell").where("place >= lo and place < hi").select("slot", "sid", "blocks")
    ranked = running(chosen, "sid", F.expr(f"slot div {RUN}"), ["slot"], F.lit(1).cast("long"), "rank")
    return ranked.selectExpr("slot", "sid", "rank div blocks epoch", "rank % blocks block_no").where(F.col("epoch") < repeats)


def mix(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", repeats: int = REPEATS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row."""
    sized = stored(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.col(source).alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")).alias("digest"),
        ),
        "sizes",
    )
    n_rows = sized.count()
    sources = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), repeats), "sources")
    n_slots = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    times = schedule(sources, n_slots, repeats).groupBy("sid", "block_no").agg(F.count("*").alias("times"))
    facts = sources.select(F.col("source").alias("_source"), "sid", "source_size", "target", "block")
    rows = sized.join(facts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    buckets = math.isqrt(n_rows) + 1
    by_digest = F.expr(f"cast(conv(substr(digest, 1, 8), 16, 10) as long) * {buckets} div {1 << 32}")
    placed = running(rows.where("size > 0"), "sid", by_digest, ["digest", "doc_id", "size"], F.col("size"), "start")
    pieces = placed.withColumn("block_no", F.explode(F.expr("sequence(start div block, (start + size - 1) div block)")))
    pieces = pieces.withColumn("part", F.expr("least(start + size, (block_no + 1) * block) - greatest(start, block_no * block)"))
    taken = (
        pieces.join(times, ["sid", "block_no"], "left")
        .groupBy("sid", "start", "doc_id", "source", "size", "source_size", "target")
        .agg(F.sum(F.expr("part * coalesce(times, 0L)")).alias("taken"))
    )
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return taken.select(*columns).unionAll(rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*columns))
