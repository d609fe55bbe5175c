"""Line deduplication with levelled sorted runs of line hashes.

Documents come in batches. The store keeps, for every line key seen so far, the first document that holds it, as sorted
runs: tables bucketed and sorted by the key's hash. A new batch brings its keys to the same buckets, is merge-joined
with the runs (no run is shuffled), and what the runs do not know becomes a run of its own. ``FANOUT`` runs of a level
are compacted into one run of the next, so there are at most ``FANOUT`` runs per level and a number of levels that grows
with the logarithm of the batches. Runs are disjoint: compaction is a union.

A line goes if its key belongs to another document: one of an earlier batch, or a smaller id of its own batch. The
whole-table form cuts the ids into ascending ranges, so a key belongs to the smallest id that holds it.

Only DataFrame functions. A key's document is a map-side combined minimum. Lines of very common keys meet their decision
by a broadcast of the at most ``HOT`` keys that hold more than a ``HOT``-th of the batch's lines; no other key is
larger than that. Lines are named by (id, hash of the text, position), so repeated rows need no row number. Keys are
128-bit hashes. Nothing but bounds of id ranges and line counts passes the driver.

Defined cases: null and empty texts are one empty line; keys shorter than ``LEAST`` code points always stay; a null id
is a document of its own, the last one; rows with one id are one document, each keeps its lines; an empty table gives an
empty result; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattfold.llm.scratch import folder, remove, written

#: White space at the ends of a line, and the shortest key that can go.
SPACE, LEAST = " \t\n\x0b\f\r", 10
FANOUT, BATCHES, HOT, BUCKET_ROWS = 3, 4, 1000, 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key(line: Column) -> Column:
    """Stripped, A-Z lowered. ``lower`` does that for ASCII lines, and faster."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _split(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def lines_of(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tx, pos, h): the lines that could go; tx tells apart texts of one id."""
    lines = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("tx"), F.posexplode(_split(text)).alias("pos", "line"))
    keyed = lines.select("id", "tx", "pos", key(F.col("line")).alias("key")).where(F.char_length("key") >= LEAST)
    return keyed.select("id", "tx", "pos", F.unhex(F.md5("key")).alias("h"))


class LineRuns:
    """The store. ``absorb`` takes one batch of ``lines_of`` and returns its lines that go."""

    def __init__(self, spark: SparkSession, *, buckets: int = 32, fanout: int = FANOUT) -> None:
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.home = folder(spark, "line-runs")
        self.runs: list[tuple[int, str]] = []  # level, table
        self._made = 0

    def _table(self, frame: DataFrame) -> str:
        """Written as a run: one sorted file per bucket."""
        self._made += 1
        path = f"{self.home}/run{self._made}"
        name = path.rsplit("/", 2)[-2].replace("-", "_") + f"_{self._made}"
        frame.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        return name

    def _run(self, table: str) -> DataFrame:
        return self.spark.table(table).where("not old").select("h", "owner")

    def _decided(self, lines: DataFrame) -> DataFrame:
        """(h, owner, old, shared, n) per key of the batch: merge join with every run, the batch's own minimum for the rest."""
        found = lines.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("id").alias("named"), F.count("*").alias("n"))
        found = found.repartition(self.buckets, "h").withColumns({"old": F.lit(False), "owner": F.col("first")})
        for _, table in self.runs:
            run = self._run(table).withColumnsRenamed({"owner": "_owner"}).withColumn("_hit", F.lit(True))
            hit = F.col("_hit").isNotNull()
            found = found.join(run, "h", "left").withColumns({"owner": F.when(hit, F.col("_owner")).otherwise(F.col("owner")), "old": F.col("old") | hit})
            found = found.drop("_owner", "_hit")
        shared = (F.col("first") < F.col("last")) | ((F.col("named") > 0) & (F.col("named") < F.col("n")))
        return found.select("h", "owner", "old", (F.col("old") | F.coalesce(shared, F.lit(False))).alias("shared"), "n")

    def absorb(self, lines: DataFrame) -> DataFrame:
        """(id, tx, pos) of the batch's lines that go. ``lines`` is read more than once: a written table is best."""
        table = self._table(self._decided(lines))
        self.runs.append((0, table))
        shared = self.spark.table(table).where("shared").select("h", "owner", "n")
        total = self.spark.table(table).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        hot = F.broadcast(shared.where(F.col("n") > total // HOT).select("h", F.col("owner").alias("_owner"), F.lit(True).alias("_hot")))
        marked = lines.join(hot, "h", "left")
        common = marked.where("_hot and not (id <=> _owner)").select("id", "tx", "pos")
        rest = shared.where(F.col("n") <= total // HOT).select("h", "owner")
        rare = marked.where("_hot is null").join(rest, "h").where("not (id <=> owner)").select("id", "tx", "pos")
        gone = written(common.unionAll(rare), f"{self.home}/gone{self._made}")
        self._compact()
        return gone

    def _compact(self) -> None:
        """As long as a level is full, its runs become one run of the next level."""
        level = 0
        while len(full := [t for at, t in self.runs if at == level]) >= self.fanout:
            whole = self._run(full[0])
            for table in full[1:]:
                whole = whole.unionAll(self._run(table))
            one = self._table(whole.withColumns({"old": F.lit(False), "shared": F.lit(False), "n": F.lit(0).cast("long")}).repartition(self.buckets, "h"))
            self.runs = [r for r in self.runs if r[1] not in full] + [(level + 1, one)]
            for table in full:
                self._drop(table)
            level += 1

    def _drop(self, table: str) -> None:
        self.spark.sql(f"drop table {table}")
        remove(self.spark, f"{self.home}/run{table.rsplit('_', 1)[1]}")

    def close(self) -> None:
        """Removes the runs; what ``absorb`` returned stays until the application ends."""
        for _, table in self.runs:
            self._drop(table)
        self.runs = []


def strip(docs: DataFrame, gone: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept): each row without the lines in ``gone``."""
    places = gone.groupBy("id", "tx").agg(F.collect_set("pos").alias("_gone")).withColumnsRenamed({"id": "_id", "tx": "_tx"})
    rows = docs.select(F.col(id_column).alias(id_column), F.col(text).alias("_text"), F.xxhash64(text).alias("_at"))
    rows = rows.join(places, F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_at") == F.col("_tx")), "left")
    rows = rows.withColumn("_lines", _split("_text"))
    stay = F.expr("array_except(sequence(0, size(_lines) - 1), _gone)")
    kept = F.when(F.col("_gone").isNull(), F.coalesce("_text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    dropped = F.coalesce(F.when(F.col("_gone").isNotNull(), F.size("_gone")), F.lit(0)).cast("long")
    return rows.select(id_column, F.size("_lines").cast("long").alias("n_lines"), dropped.alias("n_dropped"), kept.alias("kept"))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """(id, n_lines, n_dropped, kept) for every row: the ids' ranges as ``batches``, one after the other."""
    spark = docs.sparkSession
    bare = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    cuts = bare.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)])).first()[0] or []
    batch = sum([F.when(F.col("id") > cut, 1).otherwise(0) for cut in sorted(set(cuts))], F.lit(0))
    batch = F.when(F.col("id").isNull(), len(set(cuts))).otherwise(batch)
    home = folder(spark, "lines")
    lines = written(lines_of(bare, "id", "text").withColumn("batch", batch.cast("int")), home + "/all", "batch")
    runs = LineRuns(spark, buckets=max(8, lines.count() // BUCKET_ROWS + 1))
    gone = None
    for at in range(len(set(cuts)) + 1):
        part = runs.absorb(lines.where(F.col("batch") == at).drop("batch"))
        gone = part if gone is None else gone.unionAll(part)
    runs.close()
    remove(spark, home)
    return strip(docs, gone, id_column, text)
