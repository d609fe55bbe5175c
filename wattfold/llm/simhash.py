"""SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprints are majority votes over the XXH64 values of a text's word shingles. For a radius r the 64 bits are given
codes in GF(2)^(r+1); each of the 2^(r+1) - 1 non-zero vectors v makes a mask of the bits whose code is not orthogonal
to v. The codes of any r bits leave some v orthogonal to all of them, so two fingerprints that differ in at most r bits
agree under that mask: no pair within the radius is missed. Fingerprints that agree under a mask are compared exactly.

A bucket of more than ``BUCKET`` different fingerprints is not compared all against all: its free bits are covered anew
by the same rule, which is exact again. Each new mask adds at least one bit, so it ends where at most 2^free fingerprints
are possible.

Defined cases: words are runs without ASCII white space; only A-Z is lowered; a text of fewer words than a shingle is
one shingle; null texts and texts without words have the fingerprint zero, which links like any other; repeated rows
and repeated ids each give a row; ids may be null (they never name a component unless all its ids are null); an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattfold.llm.graph import components, stored

BITS, SEED, CHUNK, BUCKET = 64, 42, 1 << 15, 256


def _mix(h: np.ndarray, plane: int) -> np.ndarray:
    """Independent hash bits of the same shingles for further fingerprints (the finaliser of splitmix64)."""
    if not plane:
        return h
    z = h + np.uint64(0x9E3779B97F4A7C15 * plane & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _ones(h: np.ndarray) -> np.ndarray:
    """How often each bit is set."""
    bits = np.zeros((-(-len(h) // 255) * 255, BITS), dtype=np.uint8)
    bits[: len(h)] = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def majority(h: np.ndarray, planes: int = 1) -> list[int]:
    """Unsigned fingerprints of hashed shingles, one for each plane. Long arrays are taken in chunks."""
    ones = np.zeros((planes, BITS), dtype=np.int64)
    for at in range(0, len(h), CHUNK):
        for p in range(planes):
            ones[p] += _ones(_mix(h[at : at + CHUNK], p))
    return np.packbits(ones * 2 > len(h), axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprint(text: str | None, shingle: int = 3, planes: int = 1) -> list[int]:
    """Unsigned fingerprints of a text, one for each plane."""
    words = (text or "").encode().lower().split()  # bytes: splits at 0x09-0x0D and 0x20, lowers A-Z
    if not words:
        return [0] * planes
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    places = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in places), dtype=np.uint64, count=n), planes)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, planes: int = 1, column: str = "fps") -> DataFrame:
    """The input's columns and ``column``: its fingerprints as signed longs."""
    kept = [c for c in docs.columns if c != column]
    place = kept.index(text)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(column, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.array(fingerprint(t, shingle, planes), dtype=np.uint64).view(np.int64).tolist() for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.int64()))], [*kept, column])

    return docs.select(*(docs[c] for c in kept)).mapInArrow(run, schema)


def cover(mask: int, radius: int) -> list[int]:
    """Masks that add bits free in ``mask``: any ``radius`` of the free bits stay free in at least one of them."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    if len(free) <= radius:
        raise ValueError("fingerprints that differ in free bits only are all within the radius")
    codes = sorted(range(1, 1 << radius + 1), key=int.bit_count)  # unit codes first: every v is not orthogonal to one of them
    made = [sum(1 << b for j, b in enumerate(free) if (codes[j % len(codes)] & v).bit_count() & 1) for v in codes]
    assert all(made), "each mask must add a bit, or large buckets come again for ever"
    return list(dict.fromkeys(mask | x for x in made))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Ties each fingerprint of a bucket to the first one of its component within the bucket."""
    fps = fps.view(np.uint64)  # of a negative number the bits of its absolute value would be counted
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    open_, out = set(range(len(fps))), []
    while open_:
        first = min(open_)
        open_.discard(first)
        front = [first]
        while front:
            reached = [j for j in np.flatnonzero(near[front].any(axis=0)).tolist() if j in open_]
            open_.difference_update(reached)
            out += [(first, j) for j in reached]
            front = reached
    return out


def _rows(plane, mask, a, b, open_: bool) -> np.ndarray:
    made = np.empty((5, len(a)), dtype=np.int64)
    made[0], made[1], made[2], made[3], made[4] = plane, mask, a, b, open_
    return made


def _within(radius: int, bucket: int):
    """Over rows (plane, mask, val, fp) sorted by key: links (a, b) within buckets; rows of too large buckets have no b.

    Holds one batch and at most ``bucket`` rows more.
    """

    def cut(rows: np.ndarray, hot, last: bool):
        """Links of the buckets that end in ``rows``; what is left of the last bucket; its key if it is a large one."""
        out, keys = [], rows[:3]
        if not rows.shape[1]:
            return out, rows, hot
        at = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        begins, ends = np.concatenate(([0], at)), np.concatenate((at, [rows.shape[1]]))
        final = len(begins) - 1
        for k in sorted({0, final, *np.flatnonzero(ends - begins > 1).tolist()}):
            part = rows[:, begins[k] : ends[k]]
            key = tuple(part[:3, 0].tolist())
            if key == hot or part.shape[1] > bucket:
                out.append(_rows(key[0], key[1], part[3], 0, True))
                hot = key
                if k == final:
                    return out, rows[:, :0], hot
            elif k < final or last:
                tied = _forest(part[3], radius)
                if tied:
                    i, j = np.array(tied).T
                    out.append(_rows(key[0], key[1], part[3, i], part[3, j], False))
        return out, rows[:, :0] if last else rows[:, begins[final] :], hot

    def batch_of(out: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(out, axis=1)
        return pa.RecordBatch.from_arrays(
            [pa.array(x[0].astype(np.int32)), pa.array(x[1]), pa.array(x[2]), pa.array(x[3], mask=x[4] > 0)], ["plane", "mask", "a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, hot = np.zeros((4, 0), dtype=np.int64), None
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            out, rest, hot = cut(np.concatenate([rest, rows], axis=1), hot, False)
            if out:
                yield batch_of(out)
        out, _, _ = cut(rest, hot, True)
        if out:
            yield batch_of(out)

    return run


def links(fps: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(plane, a, b) over distinct (plane, fp): ties that join all fingerprints within ``radius`` of each other.

    Every tie lies within a chain of fingerprints at most ``radius`` apart, and any two such fingerprints are tied
    through some chain of ties.
    """
    bucket = max(bucket, 1 << radius)  # a bucket with at most ``radius`` free bits is never too large
    first = [_signed(m) for m in cover(0, radius)]
    rows = fps.select("plane", "fp", F.explode(F.array(*map(F.lit, first))).alias("mask"))
    found = None

    @F.pandas_udf("array<long>")
    def finer(masks):
        known = {m: [_signed(x) for x in cover(int(m) & (1 << BITS) - 1, radius)] for m in masks.unique().tolist()}
        return masks.map(known)

    while True:
        keyed = rows.select("plane", "mask", F.col("mask").bitwiseAND(F.col("fp")).alias("val"), "fp")
        dealt = keyed.repartition("plane", "mask", "val").sortWithinPartitions("plane", "mask", "val", "fp")
        made = stored(dealt.mapInArrow(_within(radius, bucket), "plane int, mask long, a long, b long"), "links")
        ties = made.where("b is not null").select("plane", "a", "b").distinct()
        found = ties if found is None else found.unionAll(ties)
        large = made.where("b is null").select("plane", "mask", F.col("a").alias("fp"))
        if large.isEmpty():
            return found
        rows = large.select("plane", "fp", F.explode(finer("mask")).alias("mask"))


def grouped(printed: DataFrame, radius: int = 2, column: str = "fps") -> DataFrame:
    """(fp0, root) for fingerprints of plane 0 that have a link: root is the smallest (signed) one of the component."""
    each = printed.select(F.col(column)[0].alias("fp0"), F.posexplode(column).alias("plane", "fp")).distinct()
    tied = links(each.select("plane", "fp").distinct(), radius)
    edges = tied.where("plane = 0").selectExpr("a u", "b v")
    if not each.where("plane > 0").isEmpty():
        nodes = components(tied.where("plane > 0").selectExpr("struct(plane, a fp) u", "struct(plane, b fp) v"))
        placed = each.where("plane > 0").withColumn("node", F.struct("plane", "fp")).join(nodes, "node", "left")
        placed = placed.select("fp0", F.coalesce("root", "node").alias("hub"))
        least = placed.groupBy("hub").agg(F.min("fp0").alias("least"), F.max("fp0").alias("most")).where("least <> most")
        edges = edges.unionAll(placed.join(least, "hub").where("fp0 <> least").selectExpr("fp0 u", "least v").distinct())
    return components(edges).withColumnRenamed("node", "fp0")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest id of the component."""
    printed = stored(
        fingerprints(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")), shingle=shingle).selectExpr("doc_id", "fps"),
        "fingerprints",
    )
    roots = grouped(printed, radius)
    least = printed.groupBy(F.col("fps")[0].alias("fp0")).agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    placed = least.join(roots, "fp0", "left").withColumn("root", F.coalesce("root", "fp0"))
    of_root = placed.groupBy("root").agg(F.min("id").alias("component_id"), F.sum("n").alias("n")).where("n > 1")
    known = stored(placed.join(of_root, "root").select("fp0", "component_id"), "components")  # groups only
    return (
        printed.withColumn("fp0", F.col("fps")[0])
        .join(known, "fp0", "left")
        .select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )
