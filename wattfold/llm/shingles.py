"""Near-duplicate documents by the Jaccard similarity of their sets of word shingles.

Candidates come from SimHash through covering masks (``simhash``): ``PLANES`` fingerprints of a set of shingles, and no two
texts within ``RADIUS`` bits in one of them are missed. That radius is too small for pairs near the bound (some 1 in 50 per
fingerprint at 0.8), and masks grow as 2^radius, so min-hashes give candidates as well: ``BANDS`` keys of ``ROWS`` min-hashes
each, so a pair of similarity s has a key in common with probability 1 - (1 - s^ROWS)^BANDS (0.998 at 0.8). Every candidate
pair that is not linked already is checked on the texts themselves: it is a link if at least ``LEAST`` of the shingles of
both are shared. Links make groups.

Texts with equal sets of shingles are one node from the start. Of a bucket (texts with a key in common, or with
fingerprints tied to each other by steps within the radius), all are first
checked against the smallest one; buckets that still hold different groups are then compared whole, all against all, in tiles of
texts. A bucket of copies thus costs one check per copy; one of n unlike texts is dealt as n * n / ``TILE`` rows.

Defined cases: words are runs without ASCII white space; only A-Z is lowered; a text of fewer words than a shingle is
one shingle; null texts and texts without words are copies of each other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattfold.llm import simhash
from wattfold.llm.graph import components, stored
from wattfold.llm.scratch import bucketed, folder

LEAST, BANDS, ROWS, SEED, CHUNK, TILE, HELD = 0.8, 20, 6, 42, 1 << 12, 256, 16
#: Fingerprints of a set, and the bits in which those of a candidate pair may differ.
PLANES, RADIUS = 2, 4
#: Rows per bucket of the tables that hold texts, and the most buckets.
BUCKET_ROWS, BUCKETS = 8192, 50_000


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the different word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    places = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in places), dtype=np.uint64, count=n))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def keys(hashes: np.ndarray) -> list[int]:
    """One signed key per band; none for a text without words."""
    if not len(hashes):
        return []
    factor, offset = _factors()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[at : at + CHUNK, None] * factor + offset).min(axis=0))
    made = [xxhash.xxh64_intdigest(band.tobytes(), at) for at, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(made, dtype=np.uint64).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 1.0


def printed(docs: DataFrame, text: str, size: int) -> DataFrame:
    """The input's columns, ``_set`` (digest of the set of shingles), ``_keys`` and ``_fps`` (none of a text without words)."""
    place, longs = docs.columns.index(text), T.ArrayType(T.LongType())
    schema = T.StructType([*docs.schema, T.StructField("_set", T.BinaryType()), T.StructField("_keys", longs), T.StructField("_fps", longs)])
    names = schema.names

    def prints(hashes: np.ndarray) -> list[int]:
        return np.array(simhash.majority(hashes, PLANES), dtype=np.uint64).view(np.int64).tolist() if len(hashes) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, bands, fps = [], [], []
            for text in batch.column(place):  # one text and its set at a time
                hashes = shingles(text.as_py(), size)
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                bands.append(keys(hashes))
                fps.append(prints(hashes))
            made = (pa.array(x, pa.list_(pa.int64())) for x in (bands, fps))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary()), *made], names)

    return docs.mapInArrow(run, schema)


def checked(pairs: DataFrame, texts: DataFrame, size: int, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) whose texts share at least ``least`` of their shingles. ``texts`` lies in buckets by ``_set``: of
    them only those that come first in a pair are shuffled, and move on to the second ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}  # of texts that come first, the last few
        for batch in batches:
            a, b, text_a, text_b = (batch.column(i) for i in range(4))
            good = []
            for i in range(len(a)):
                name = a[i].as_py()
                if name not in held:
                    if len(held) >= HELD:
                        held.pop(next(iter(held)))
                    held[name] = shingles(text_a[i].as_py(), size)
                good.append(similarity(held[name], shingles(text_b[i].as_py(), size)) >= least)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(good)), b.filter(pa.array(good))], ["a", "b"])

    first = texts.join(pairs.select(F.col("a").alias("_set")).distinct(), "_set").selectExpr("_set a", "text text_a")
    both = pairs.join(first, "a").join(texts.selectExpr("_set b", "text text_b"), "b")
    return stored(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary"), "links")


def _near(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For all pairs of sets: whether they share at least ``least`` of their shingles."""
    size = np.array([len(x) for x in sets], dtype=np.float64)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    _, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    held = (n > 1)[place]
    owner, place = owner[held], column[place[held]]
    shared = np.zeros((len(sets), len(sets)))
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for at in range(0, int(column[-1]) + 1, CHUNK):
        i, j = np.searchsorted(place, [at, at + CHUNK])
        has = np.zeros((len(sets), CHUNK), dtype=np.float32)
        has[owner[i:j], place[i:j] - at] = 1
        shared += has @ has.T
    return shared / (size[:, None] + size[None, :] - shared) >= least


def _ties(names: list[bytes], roots: list[bytes], sets: list[np.ndarray], least: float) -> list[tuple[bytes, bytes]]:
    """Links that join all groups (members of one root are joined already) with a link between them."""
    near = _near(sets, least)
    root = np.unique(np.array([r.hex() for r in roots]), return_inverse=True)[1]
    out = []
    while True:
        i, j = np.nonzero(near & (root[:, None] < root[None, :]))
        if not len(i):
            return out
        _, first = np.unique(root[j], return_index=True)  # one link for each group that goes into a smaller one
        into = dict(zip(root[j[first]].tolist(), root[i[first]].tolist(), strict=True))
        out += [tuple(sorted((names[x], names[y]))) for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True)]
        for r in sorted(into):
            into[r] = into.get(into[r], into[r])
        root = np.array([into.get(r, r) for r in root.tolist()])


def tiles(rest: DataFrame, texts: DataFrame, size: int, least: float = LEAST) -> DataFrame:
    """Links (a, b) between different roots of a bucket, from (band, key, n, _set, root): all pairs are compared, in
    tiles of about two times ``TILE`` texts. A bucket of n texts is dealt as n * n / TILE rows."""
    parts = rest.withColumn("parts", F.ceil(F.col("n") / TILE).cast("int"))
    own = parts.withColumn("i", F.expr("cast(pmod(xxhash64(_set), parts) as int)"))
    dealt = own.withColumn("j", F.explode(F.expr("sequence(0, parts - 1)"))).selectExpr("band", "key", "least(i, j) i", "greatest(i, j) j", "_set", "root")
    dealt = dealt.join(texts.selectExpr("_set", "text"), "_set").select("band", "key", "i", "j", "_set", "root", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, names, roots, sets = None, [], [], []
        for batch in batches:
            out = []
            for *at, name, root, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != tile:
                    out += _ties(names, roots, sets, least) if len(names) > 1 else []
                    tile, names, roots, sets = at, [], [], []
                names.append(name)
                roots.append(root)
                sets.append(shingles(text, size))
            yield _batch(out)
        yield _batch(_ties(names, roots, sets, least) if len(names) > 1 else [])

    order = ("band", "key", "i", "j")
    return stored(dealt.repartition(*order).sortWithinPartitions(*order, "_set").mapInArrow(run, "a binary, b binary").distinct(), "ties")


def _batch(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])


def alike(nodes: DataFrame) -> DataFrame:
    """(_set, band, key): per fingerprint a key for the sets that steps within the radius lead to, found by covering masks."""
    each = nodes.select("_set", F.posexplode("_fps").alias("plane", "fp"))
    tied = simhash.links(each.select("plane", "fp").distinct(), RADIUS)
    hubs = components(tied.selectExpr("struct(plane, a fp) u", "struct(plane, b fp) v"))
    placed = each.withColumn("node", F.struct("plane", "fp")).join(hubs, "node", "left")
    return placed.select("_set", (F.col("plane") + BANDS).alias("band"), F.coalesce("root.fp", "fp").alias("key"))


def groups(nodes: DataFrame, rows: DataFrame, buckets: int, size: int, least: float = LEAST) -> DataFrame:
    """(node, root) of the sets that have a link, from nodes (_set, _keys, _fps, _row); ``rows`` (_row, text) lies in buckets by ``_row``."""
    spark = nodes.sparkSession
    every = nodes.select("_set", F.posexplode("_keys").alias("band", "key")).unionAll(alike(nodes))
    bucket = Window.partitionBy("band", "key")
    full = every.withColumns({"lead": F.min("_set").over(bucket), "n": F.count("*").over(bucket)})
    held = stored(full.where("n > 1").select("band", "key", "_set", "lead"), "buckets")  # texts that share a key only
    asked = nodes.select("_set", "_row").join(held.select("_set").distinct(), "_set")
    known = bucketed(rows.join(asked, "_row").select("_set", "text"), folder(spark, "texts") + "/all", "_set", buckets)
    links = checked(stored(held.where("_set <> lead").selectExpr("lead a", "_set b").distinct(), "pairs"), known, size, least)
    tied = components(links.selectExpr("a u", "b v"))
    placed = held.drop("lead").join(tied, F.col("_set") == F.col("node"), "left")
    placed = placed.select("band", "key", "_set", F.coalesce("root", "_set").alias("root"))
    mixed = placed.withColumns({"r0": F.min("root").over(bucket), "r1": F.max("root").over(bucket), "n": F.count("*").over(bucket)})
    rest = stored(mixed.where("r0 <> r1 and n > 2").select("band", "key", "n", "_set", "root"), "open")  # a pair has been checked
    more = tiles(rest, known, size, least)
    if more.isEmpty():
        return tied
    return components(tied.selectExpr("node u", "root v").unionAll(more.selectExpr("a u", "b v")))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5, least: float = LEAST) -> DataFrame:
    """The input without all but one row (the smallest id) of each group.

    Whole texts are shuffled once, into buckets by a number of the row; to fetch the texts that have to be checked and to
    take the surplus rows out moves row numbers only.
    """
    spark, given = docs.sparkSession, [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*given)  # whatever the columns are called
    named = dict(zip(docs.columns, given, strict=True))
    made = printed(plain, named[text], size).withColumn("_row", F.monotonically_increasing_id())
    buckets = min(BUCKETS, max(8, docs.count() // BUCKET_ROWS + 1))
    rows = bucketed(made, folder(spark, "documents") + "/all", "_row", buckets)
    nodes = stored(rows.groupBy("_set").agg(F.first("_keys").alias("_keys"), F.first("_fps").alias("_fps"), F.min("_row").alias("_row")), "sets")
    texts = rows.select("_row", F.col(named[text]).alias("text"))
    roots = stored(groups(nodes, texts, buckets, size, least), "roots")
    # The smallest row of each set first (copies are added up on the way), then that of each group of sets.
    best = rows.groupBy("_set").agg(F.min(F.struct(F.col(named[id_column]).isNull().alias("no"), F.col(named[id_column]).alias("id"), "_row")).alias("first"))
    winners = best.join(roots, F.col("_set") == F.col("node"), "left").groupBy(F.coalesce("root", "_set")).agg(F.min("first").alias("first"))
    kept = rows.join(winners.select(F.col("first._row").alias("_row")), "_row", "left_semi")
    return kept.select(*given).toDF(*docs.columns)
