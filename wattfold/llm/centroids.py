"""Centroid clustering: k-means over whole numbers, nearest centroids by a tournament of bisectors.

Components become floor(scale * x), and everything from there on is exact. For centroids a < b, ``b`` is nearer than
``a`` if and only if 2(b - a) . v > |b|^2 - |a|^2: an integer normal and a threshold per pair, made once a round. A
vector keeps a champion, starting with centroid 0, which meets 1, 2, ... in turn: k - 1 sign tests, each of which sends
one centroid home. Zero means equally near and favours the smaller number, the champion. Distances are only taken to
the winner.

Vectors are read afresh in every round (no table of them is written); a task adds up its vectors per cluster, so a round
sends at most k rows per task, and k rows pass the driver. Centroids travel with the tasks: k * dimensions numbers.

Defined cases: null vectors, vectors of another length, and those with a null or non-finite component are not kept; with
fewer than k kept vectors there are as many centroids as vectors; repeated rows and ids are vectors of their own, equal
digests are ordered by the vectors; a null id has the digest of ``<seed>:``; without any kept vector the result is
empty; other columns are ignored, whatever their names. A component beyond ``MOST`` after scaling is an error, as its
squared distance would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, 1
MOST = 1 << 27


class Bisectors:
    """Normals and thresholds of all pairs of the given centroids."""

    def __init__(self, centroids: list[list[int]]) -> None:
        self.at = np.array(centroids, dtype=np.int64)
        squares = (self.at * self.at).sum(axis=1)
        self.normals = 2 * (self.at[None, :, :] - self.at[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner of each vector, and its squared distance to it."""
        champion = np.zeros(len(vectors), dtype=np.int64)
        for rival in range(1, len(self.at)):
            side = np.einsum("ij,ij->i", vectors, self.normals[champion, rival]) - self.thresholds[champion, rival]
            champion[side > 0] = rival
        away = vectors - self.at[champion]
        return champion, np.einsum("ij,ij->i", away, away)


def whole_numbers(vectors: DataFrame, id_column: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """(id, v): the kept vectors as integers."""
    given = vectors.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = given.where((F.size("v") == dimensions) & finite)

    def step(x: Column) -> Column:
        whole = F.floor(x * scale)
        return F.when(F.abs(x) <= MOST // scale, whole).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long"))

    return kept.select("id", F.transform("v", step).alias("v"))


def _matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _sums(whole: DataFrame, bisectors: Bisectors, dimensions: int) -> dict[int, tuple[int, int, list[int]]]:
    """cluster: (vectors, sum of distances, sum of each component). Tasks send one row per cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(bisectors.at)
        n, far, total = [0] * k, [0] * k, np.zeros((k, dimensions), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch, dimensions)
            winner, distance = bisectors.nearest(v)
            for j in np.unique(winner).tolist():
                mine = winner == j
                n[j] += int(mine.sum())
                far[j] += sum(distance[mine].tolist())
                total[j] += v[mine].sum(axis=0)
        used = [j for j in range(k) if n[j]]
        names = ["cluster", "n", "far", "total"]
        columns = [used, [n[j] for j in used], [str(far[j]) for j in used], [total[j].tolist() for j in used]]
        types = [pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    parts = whole.mapInArrow(run, "cluster int, n long, far string, total array<long>")
    wide = F.array(*[F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")) for i in range(dimensions)])
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("far").cast("decimal(38,0)")).alias("far"), wide.alias("total"))
    return {r["cluster"]: (r["n"], int(r["far"]), [int(x) for x in r["total"]]) for r in rows.collect()}


def _first(whole: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest digests."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in whole.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()]


def cluster(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    *,
    k: int = K,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every kept vector."""
    whole = whole_numbers(vectors, id_column, vector, dimensions, scale)
    at = _first(whole, k, seed)
    schema = T.StructType(
        [
            T.StructField(id_column, vectors.schema[id_column].dataType),
            T.StructField("cluster", T.IntegerType()),
            T.StructField("distance", T.LongType()),
            T.StructField("cluster_inertia", T.LongType()),
            T.StructField("inertia", T.LongType()),
            T.StructField("centroid_sha256", T.StringType()),
        ]
    )
    if not at:
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        for j, (n, _, total) in _sums(whole, Bisectors(at), dimensions).items():
            at[j] = [x // n for x in total]
    last = Bisectors(at)
    far = {j: s[1] for j, s in _sums(whole, last, dimensions).items()}
    inertia = sum(far.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            winner, distance = last.nearest(_matrix(batch, dimensions))
            names = winner.tolist()
            columns = [
                batch.column("id"),
                pa.array(names, pa.int32()),
                pa.array(distance),
                pa.array([far[j] for j in names], pa.int64()),
                pa.array([inertia] * len(names), pa.int64()),
                pa.array([digests[j] for j in names]),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return whole.mapInArrow(run, schema)
