"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one, where the nearest by distance are the nearest by cosine. Each of ``tables`` hash
tables cuts a few Gaussian projections into slots; a bucket is a tuple of slots. A query visits, in every table, its own
bucket and those reached by perturbing slots, in order of the estimated chance that a neighbour lies there (sum of the
squared distances to the slot borders crossed). Candidates of all tables are merged and the best by the projected
float arithmetic are scored exactly, in double precision, on the original vectors.

Equal vectors are one class: it is hashed once and holds its k + 1 smallest ids, which is all that ranks can need, so
a hot vector costs nothing. Buckets are cut into pieces of about ``PIECE`` vectors by a hash; every piece meets the probes
of its bucket and hands on its k + 3 best per query, so no bucket is one task and none is capped.

Few projections and wide slots: on vectors without clusters (a nearest cosine of 0.5 in 64 dimensions) the share of
neighbours found is hardly above the share of vectors scanned, so a recall of 0.9 takes broad buckets. Clustered data
can have more ``lines`` and narrower slots.

Queries with fewer than k neighbours found are answered by a scan of the classes in blocks (exact).

Defined cases: vectors that are null, empty, zero, of another length than most, or that hold null or non-finite values
take no part; null ids take no part; repeated ids count as rows of their own, and a query leaves out all rows of its id;
ties go to the smaller id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattfold.llm.graph import stored

TABLES, LINES, PROBES, PIECE, WIDTH, SEED = 2, 4, 24, 65_536, 2.0, 7


def plan(dim: int, tables: int = TABLES, lines: int = LINES, width: float = WIDTH, seed: int = SEED) -> dict:
    """Projections and offsets. Projected unit vectors have about unit variance; ``width`` is that of a slot."""
    rng = np.random.default_rng(seed)
    m = min(lines, dim)
    drawn = rng.standard_normal((tables, m, dim))
    for t in range(tables):  # within a table the projections are orthogonal
        drawn[t] = np.linalg.qr(drawn[t].T)[0].T * np.sqrt(dim)
    return {"lines": drawn, "offset": rng.random((tables, m)) * width, "width": width}


def slots(x: np.ndarray, p: dict) -> np.ndarray:
    """Slot coordinates, (rows, tables, projections): the floor is the slot."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return (np.einsum("nd,tmd->ntm", unit, p["lines"]) + p["offset"]) / p["width"]


def probes(place: np.ndarray, count: int) -> list[tuple[int, ...]]:
    """The ``count`` likeliest buckets of one query in one table: least sum of squared distances first."""
    home = np.floor(place).astype(int)
    inside = place - home
    options = [sorted([(0.0, 0), (inside[j], -1), (1 - inside[j], 1)]) for j in range(len(place))]
    found = [(0.0, ())]
    for choices in options:  # the best of all prefixes: sums only grow, so no better bucket is lost
        found = sorted((d + x * x, (*b, s)) for (d, b), (x, s) in itertools.product(found, choices))[:count]
    return [tuple((home + np.array(b)).tolist()) for _, b in found]


def _key(bucket: np.ndarray) -> np.ndarray:
    h = np.zeros(bucket.shape[:-1], dtype=np.uint64)
    for j in range(bucket.shape[-1]):
        h = (h + bucket[..., j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def classes(vectors: DataFrame, id_column: str, vector: str, k: int) -> DataFrame:
    """(cls, vec, ids): the vectors that take part, with the k + 1 smallest different ids of each."""
    given = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    good = given.where("id is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vec, x -> x <> 0)")
    good = good.withColumn("vec", F.expr("transform(vec, x -> x + 0d)"))
    # partial lists keep k + 1 ids only, so a hot vector is no large group
    near = good.groupBy("vec", F.pmod(F.hash("id"), F.lit(64)).alias("part")).agg(F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids"))
    near = near.groupBy("vec").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    return near.select(F.expr("ids[0]").alias("cls"), "vec", "ids")


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", tables: int = TABLES, visits: int = PROBES
) -> DataFrame:
    """(query_id, rank, vec_id, score) for every query that takes part."""
    spark = vectors.sparkSession
    known = stored(classes(vectors, id_column, vector, k), "classes")
    asked_rows = stored(_clean(queries, id_column, vector).distinct(), "queries")
    sizes = known.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dim = sizes[0][0]
    known, asked_rows = known.where(F.size("vec") == dim), asked_rows.where(F.size("vec") == dim)
    # one search for each different query vector
    asked = stored(asked_rows.groupBy("vec").agg(F.min("id").alias("q")), "asked")
    p = plan(dim, tables)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["vec"])
            keys = _key(np.floor(slots(x, p)).astype(np.int64))
            small = [v.tobytes() for v in x.astype(np.float32)]
            for t in range(keys.shape[1]):
                yield pd.DataFrame({"tab": t, "key": keys[:, t], "q": None, "id": b["cls"], "v": small})

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["vec"])
            place = slots(x, p)
            for q, row, v in zip(b["q"], place, x.astype(np.float32), strict=True):
                for t in range(len(row)):
                    keys = _key(np.array(probes(row[t], visits)))
                    yield pd.DataFrame({"tab": t, "key": keys, "q": q, "id": None, "v": v.tobytes()})

    shape = "tab int, key long, q long, id long, v binary"
    index = known.select("cls", "vec").mapInPandas(hashed, shape)
    tries = asked.mapInPandas(probed, shape)
    held = stored(index, "index")
    heavy = stored(held.groupBy("tab", "key").agg(F.count("*").alias("n")).where(F.col("n") > PIECE).select("tab", "key", F.expr(f"cast(ceil(n / {PIECE}) as int)").alias("cut")), "heavy")
    index = held.join(heavy, ["tab", "key"], "left").withColumn("piece", F.expr("pmod(hash(id), coalesce(cut, 1))")).drop("cut")
    tries = tries.join(heavy, ["tab", "key"], "left").withColumn("piece", F.explode(F.expr("sequence(0, coalesce(cut, 1) - 1)"))).drop("cut")
    both = index.unionByName(tries).repartition("tab", "key", "piece").sortWithinPartitions("tab", "key", "piece", F.col("q").asc_nulls_last())

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a bucket piece come together, its queries first; candidates are scored as they pass."""
        now, asked_now, best = None, None, {}

        def flush():
            rows = [(q, i, s) for q, found in best.items() for s, i in found]
            return pd.DataFrame(rows, columns=["q", "id", "s"])

        for b in batches:
            for key, part in b.groupby(["tab", "key", "piece"], sort=False):
                if key != now:
                    if best:
                        yield flush()
                    now, asked_now, best = key, [], {}
                mark = part["q"].notna()
                for q, v in zip(part.loc[mark, "q"], part.loc[mark, "v"], strict=True):
                    asked_now.append((int(q), np.frombuffer(v, dtype=np.float32)))
                mine = part.loc[~mark]
                if not asked_now or not len(mine):
                    continue
                x = np.frombuffer(b"".join(mine["v"]), dtype=np.float32).reshape(len(mine), -1)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
                ids = mine["id"].to_numpy(dtype=np.int64)
                for at in range(0, len(asked_now), 256):
                    block = asked_now[at : at + 256]
                    s = np.stack([v / max(float(np.linalg.norm(v)), 1e-30) for _, v in block]) @ x.T
                    top = np.argpartition(-s, min(k + 3, s.shape[1]) - 1, axis=1)[:, : k + 3]
                    for (q, _), row, first in zip(block, s, top, strict=True):
                        best[q] = sorted(best.get(q, []) + [(float(row[i]), int(ids[i])) for i in first], key=lambda r: (-r[0], r[1]))[: k + 3]
        if best:
            yield flush()

    near = both.mapInPandas(compared, "q long, id long, s float").groupBy("q", "id").agg(F.max("s").alias("s"))
    order = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    near = stored(near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 2 * k + 6).select("q", F.col("id").alias("cls")), "near")
    found = _ranked(near, asked, asked_rows, known, k)
    few = stored(found.groupBy("query_id").agg(F.count("*").alias("n")), "counts")
    short = stored(asked_rows.join(few, F.col("id") == F.col("query_id"), "left").where(f"coalesce(n, 0) < {k}").select("id", "vec"), "short")
    if short.isEmpty():
        return found
    rest = _scan(short, asked, known, k)
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(_ranked(rest, asked, short, known, k))


def _clean(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    given = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    good = given.where("id is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vec, x -> x <> 0)")
    return good.withColumn("vec", F.expr("transform(vec, x -> x + 0d)"))


def _ranked(near: DataFrame, asked: DataFrame, rows: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """Exact scores of (q, cls), spread over the queries with that vector and the ids of the classes."""

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x, y = _matrix(a), _matrix(b)
        return pd.Series((x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))))

    pairs = near.join(asked.withColumnRenamed("vec", "a"), "q").join(known.select("cls", F.col("vec").alias("b"), "ids"), "cls")
    scored = pairs.select("q", "ids", cosine("a", "b").alias("score"))
    each = scored.select("q", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = each.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("list"))
    own = rows.join(asked, "vec").select("id", "q")
    out = own.join(lists, "q").select(F.col("id").alias("query_id"), F.posexplode(F.expr(f"slice(filter(list, x -> x.vec_id <> id), 1, {k})")).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _scan(short: DataFrame, asked: DataFrame, known: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(q, cls): the k + 3 nearest classes of each of the few queries left, by blocks of queries over all classes."""
    spark = known.sparkSession
    left = short.join(asked, "vec").select("q", "vec").distinct().withColumn("at", F.row_number().over(Window.orderBy("q")) - 1)
    left = stored(left, "left")
    out = spark.createDataFrame([], "q long, cls long, s double")
    for start in range(0, left.count(), block):
        rows = left.where((F.col("at") >= start) & (F.col("at") < start + block)).orderBy("at").collect()
        sent = spark.sparkContext.broadcast(([r["q"] for r in rows], _matrix([r["vec"] for r in rows])))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, asked_now = sent.value
            asked_now = asked_now / np.linalg.norm(asked_now, axis=1, keepdims=True)
            for b in batches:
                x = _matrix(b["vec"])
                s = asked_now @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                first = np.argsort(-s, axis=1, kind="stable")[:, : k + 3]
                ids = b["cls"].to_numpy()
                yield pd.DataFrame({"q": np.repeat(names, first.shape[1]), "cls": ids[first].ravel(), "s": np.take_along_axis(s, first, 1).ravel()})

        out = out.unionByName(known.select("cls", "vec").mapInPandas(run, "q long, cls long, s double"))
    order = Window.partitionBy("q").orderBy(F.desc("s"), "cls")
    return out.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 3).select("q", "cls")
