"""What micro-batches write, each counted once however often it was tried."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMMIT = "attempt STRING, batch BIGINT"


class BatchStore:
    """Rows by micro-batch below ``path``.

    Every attempt to write a batch gets a folder of its own; a commit, written last, names the attempt that counts. An
    attempt that failed half way has no commit and is not read; a batch that is repeated commits again, in place of its
    former attempt. ``merge`` puts the committed rows of many batches into one folder by a commit that stands for all
    batches up to its own, so a reader sees either the old folders or the new one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _at(self, *parts: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, *parts: str) -> bool:
        at, files = self._at(*parts)
        return files.exists(at)

    def _put(self, frame: DataFrame, kind: str, batch_id: int) -> None:
        attempt = uuid.uuid4().hex
        frame.select(*self.schema.names).write.parquet(f"{self.path}/rows/attempt={attempt}")
        commit = self.spark.range(1).select(F.lit(attempt).alias("attempt"), F.lit(batch_id).cast("bigint").alias("batch"))
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{kind}/id={batch_id}")

    def write(self, frame: DataFrame, batch_id: int) -> None:
        self._put(frame, "commits", batch_id)

    def _commits(self, kind: str) -> DataFrame:
        if not self._exists(kind):
            return self.spark.createDataFrame([], _COMMIT)
        return self.spark.read.schema(_COMMIT).option("recursiveFileLookup", True).parquet(f"{self.path}/{kind}")

    def attempts(self) -> DataFrame:
        """(attempt, batch) of what counts: the last merge, and the batches after it."""
        merged = self._commits("merged")
        last = merged.orderBy(F.desc("batch")).limit(1)
        upto = merged.agg(F.max("batch").alias("upto"))
        after = self._commits("commits").join(F.broadcast(upto), F.col("upto").isNull() | (F.col("batch") > F.col("upto")))
        return last.unionByName(after.select("attempt", "batch"))

    def read(self) -> DataFrame:
        """Committed rows."""
        if not self._exists("rows"):
            return self.spark.createDataFrame([], self.schema)
        whole = T.StructType([*self.schema, T.StructField("attempt", T.StringType())])
        rows = self.spark.read.schema(whole).parquet(f"{self.path}/rows")
        return rows.join(self.attempts().select("attempt"), "attempt", "left_semi").select(*self.schema.names)

    def merge(self, how: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Folds all committed batches into one folder, through ``how`` (partial sums to partial sums)."""
        last = self.attempts().agg(F.max("batch")).first()[0]
        if last is not None:
            self._put(how(self.read()), "merged", last)

    def vacuum(self) -> None:
        """Removes attempts that do not count. Not while a batch is being written."""
        if not self._exists("rows"):
            return
        live = {r["attempt"] for r in self.attempts().collect()}  # batches since the last merge
        at, files = self._at("rows")
        for status in files.listStatus(at):
            name = status.getPath().getName()
            if name.startswith("attempt=") and name.removeprefix("attempt=") not in live:
                files.delete(status.getPath(), True)
