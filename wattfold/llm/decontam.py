"""Benchmark decontamination by the q-gram lemma.

Texts are lowered and every run of other characters than letters and digits becomes one space. Each benchmark item is
cut into overlapping windows. A window of m characters that lies in a document with at most k edits shares at least
m - q + 1 - k*q of its q-grams with it, all on diagonals (text position less window position) that differ by at most k.
Shared q-grams are counted in diagonal bands of width 2k + 2 that overlap by half, so every such set of diagonals lies
whole in one band; bands that reach the bound are kept and verified by an alignment limited to the band's diagonals.

The documents are read once per slice of the benchmark, and a slice has at most ``SLICE_CHARS`` characters: what goes to
every task is bounded whatever the benchmark's size. There is no shuffle but the sum over matches of one pair.

Defined cases: null and empty texts match nothing; items whose normal form is shorter than ``least`` characters are not
looked for; a null id stays a null id; repeated rows give repeated matches in ``matches`` and one row per (id, item) in
``contaminated``; an empty table on either side gives an empty result; further columns are ignored by ``matches``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattfold.llm.graph import stored

Q, WINDOW, STRIDE, LEAST, BUDGET = 8, 96, 32, 40, 0.1
SLICE_CHARS, CHUNK, TOGETHER = 8_000_000, 200_000, 2048
#: Makes every cell number positive; cells stay below 2^24, places in a window below 2^12.
SHIFT = 1 << 14
_OTHER = regex.compile(r"[^\p{L}\p{M}\p{N}]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _letters() -> np.ndarray:
    """For every code point whether ``normal`` keeps it."""
    kept = np.ones(0x110000, dtype=bool)
    for run in _OTHER.finditer("".join(map(chr, range(len(kept))))):
        kept[run.start() : run.end()] = False
    return kept


def normal_points(text: str | None, kept: np.ndarray) -> np.ndarray:
    """The code points of the normal form."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    good = kept[points]
    at = np.flatnonzero(good | np.append(False, good[:-1]))  # a run of others leaves its first place, as a space
    if len(at) and not good[at[-1]]:
        at = at[:-1]
    return np.where(good[at], points[at], np.uint32(32)).astype(np.uint64)


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q-gram: equal q-grams have equal hashes. Those of 1, 2, 4, ... characters are put together."""
    n = max(0, len(points) - q + 1)
    h, done, part, size, factor = np.zeros(n, dtype=np.uint64), 0, points, 1, 0x9E3779B97F4A7C15
    while n and done < q:
        if q & size:
            h = h * np.uint64(factor) + part[done : done + n] if done else part[:n]
            done += size
        part = part[:-size] * np.uint64(factor) + part[size:]
        size, factor = 2 * size, factor * factor & (1 << 64) - 1
    return h


def aligned_all(patterns: np.ndarray, text: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For patterns of one length: fewest edits that turn each into a piece of the text on the ``width`` diagonals from
    ``low`` on, and where the piece ends. One row of all alignments at a time."""
    size, steps = patterns.shape[1], np.arange(width)
    far = size + 1
    place = low[:, None] + np.arange(width + size + 1)  # text characters used; row i has the places i .. i + width - 1
    reach = (place >= 0) & (place <= len(text))
    inside = (place >= 0) & (place < len(text))
    chars = np.append(text, 0)[np.clip(place, 0, len(text))]
    row = np.where(reach[:, :width], 0, far)
    for i in range(size):
        here = inside[:, i : i + width]
        new = np.where(here, row + ~(here & (chars[:, i : i + width] == patterns[:, i, None])), far)
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)  # a pattern character without counterpart
        new = np.minimum.accumulate(new - steps, axis=1) + steps  # text characters without counterpart
        row = np.where(reach[:, i + 1 : i + 1 + width], new, far)
    best = row.argmin(axis=1)
    return row[np.arange(len(row)), best], low + best + size


def aligned(pattern: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """The same for one pattern on diagonals low..high."""
    edits, end = aligned_all(np.asarray(pattern)[None], text, np.array([low]), high - low + 1)
    return int(edits[0]), int(end[0])


class Windows:
    """The windows of a slice of the benchmark, with their q-grams in sorted order."""

    def __init__(self, items: list[tuple], q: int, window: int, stride: int, least: int, budget: float):
        self.q, self.item, self.pattern, grams, owner, place = q, [], [], [], [], []
        self.kept = _letters()
        for item, text in items:
            points = _points(text)
            if len(points) < max(least, q):
                continue
            last = max(0, len(points) - window)
            for at in [*range(0, last, stride), last]:
                part = points[at : at + window]
                g = _grams(part, q)
                grams.append(g)
                owner.append(np.full(len(g), len(self.item)))
                place.append(np.arange(len(g)))
                self.item.append(item)
                self.pattern.append(part)
        none = [np.zeros(0, dtype=np.int64)]
        grams = np.concatenate(grams or [np.zeros(0, dtype=np.uint64)])
        order = np.argsort(grams, kind="stable")
        self.owner, self.place = np.concatenate(owner or none)[order], np.concatenate(place or none)[order]
        self.grams, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        self.likely = np.zeros(1 << 20, dtype=bool)  # by the highest bits: spares most searches
        self.likely[self.grams >> np.uint64(44)] = True
        size = np.array([len(p) for p in self.pattern], dtype=np.int64)
        self.reach = 2 * int(size.max(initial=0))
        self.edits = np.floor(size * min(budget, 0.9 / q)).astype(np.int64)  # below 1/q the bound stays above zero
        self.need = size - q + 1 - self.edits * q
        self.half = self.edits + 1

    def _bands(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """(window, lowest diagonal, highest diagonal) of the bands of a piece of text that reach the bound."""
        g = _grams(points, self.q)
        j = np.flatnonzero(self.likely[g >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.grams, g[j]), len(self.grams) - 1)
        same = self.grams[at] == g[j]
        at, j = at[same], j[same]
        n = self.count[at]
        if not len(n):
            return []
        each = np.repeat(self.first[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        owner, place, text_at = self.owner[each], self.place[each], np.repeat(j, n)
        many = (np.bincount(owner, minlength=len(self.need)) >= self.need)[owner]
        owner, place, text_at = owner[many], place[many], text_at[many]
        cell = (text_at - place + SHIFT) // self.half[owner]
        key = np.sort(owner << 24 | cell)
        whole, first = np.unique(key, return_index=True)
        counts = np.diff(np.append(first, len(key)))
        # with repeats counted, a band that stays below the bound can be left out at once
        full = counts + self._next(whole, whole, counts) >= self.need[whole >> 24]
        full |= counts + self._next(whole - 1, whole, counts) >= self.need[whole >> 24]
        full = np.isin(owner << 24 | cell, whole[full])
        # one q-gram of the window counts once in a cell, so repeated text cannot fill it
        known, counts = np.unique(np.unique((owner[full] << 24 | cell[full]) << 12 | place[full]) >> 12, return_counts=True)
        bands = np.unique(np.concatenate([known, known - 1]))  # band b has the cells b and b + 1
        w, b = bands >> 24, bands & (1 << 24) - 1
        reached = self._next(bands - 1, known, counts) + self._next(bands, known, counts) >= self.need[w]
        low = b * self.half[w] - SHIFT
        return [(int(i), int(x), int(x + 2 * self.half[i] - 1)) for i, x in zip(w[reached], low[reached], strict=True)]

    @staticmethod
    def _next(keys: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The counts of the keys that follow the given ones, zero where there is none."""
        if not len(known):
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(known, keys + 1), len(known) - 1)
        return np.where(known[at] == keys + 1, counts[at], 0)

    def _verified(self, bands: list[tuple[int, int, int]], text: np.ndarray) -> list[tuple[int, int]]:
        """Fewest edits and end of each band. An unchanged copy is seen without an alignment, the others are aligned together."""
        out: list = [None] * len(bands)
        left: dict[tuple[int, int], list[int]] = {}
        for k, (w, low, high) in enumerate(bands):
            pattern, edits = self.pattern[w], int(self.edits[w])
            begin = max(0, low - edits)
            at = text[begin : max(0, high + edits) + len(pattern)].tobytes().find(pattern.tobytes())
            if at >= 0 and at % 8 == 0:
                out[k] = (0, begin + at // 8 + len(pattern))
            else:
                left.setdefault((len(pattern), high - low + 1 + 2 * edits), []).append(k)
        for (_, width), all_of in left.items():
            for at in range(0, len(all_of), TOGETHER):
                these = all_of[at : at + TOGETHER]
                lows = np.array([bands[k][1] - int(self.edits[bands[k][0]]) for k in these])
                d, end = aligned_all(np.stack([self.pattern[bands[k][0]] for k in these]), text, lows, width)
                for k, *found in zip(these, d.tolist(), end.tolist(), strict=True):
                    out[k] = tuple(found)
        return out

    def search(self, text: str) -> list[tuple]:
        """(item, end, edits) of the windows found in a normal form."""
        return self._search(_points(text))

    def found(self, text: str | None) -> list[tuple]:
        """The same for any text."""
        return self._search(normal_points(text, self.kept)) if self.pattern else []

    def _search(self, points: np.ndarray) -> list[tuple]:
        """Long texts are searched in pieces that overlap by two windows."""
        out = []
        if not self.pattern:
            return out
        for start in range(0, max(1, len(points)), CHUNK):
            piece = points[start : start + CHUNK + self.reach]
            bands = self._bands(piece)
            last, upto = -1, 0  # window and highest diagonal of the band that was verified last
            for (w, low, high), (d, end) in zip(bands, self._verified(bands, piece), strict=True):
                if w == last and low <= upto:
                    continue
                if d <= self.edits[w]:
                    out.append((self.item[w], start + end, d))
                    last, upto = w, high
        return out


def slices(benchmark: DataFrame, item: str, text: str, chars: int = SLICE_CHARS) -> Iterator[list[tuple]]:
    """The benchmark in lists of at most ``chars`` characters (or one item), read one after the other."""
    clean = F.pandas_udf(lambda s: s.map(normal), "string")
    order = Window.partitionBy("_part").orderBy("text", "item").rowsBetween(Window.unboundedPreceding, -1)
    parts = benchmark.select(F.col(item).alias("item"), F.coalesce(text, F.lit("")).alias("text"))
    total = parts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = total // (chars // 2) + 1  # parts of half a slice on average; cut again by running length where they are larger
    cut = parts.withColumn("_part", F.pmod(F.xxhash64("text"), F.lit(n))).withColumn("text", clean("text"))
    cut = cut.withColumn("_cut", F.floor(F.coalesce(F.sum(F.length("text")).over(order), F.lit(0)) / chars))
    cut = stored(cut, "benchmark")
    for part, at in sorted(tuple(r) for r in cut.select("_part", "_cut").distinct().collect()):
        yield [(r["item"], r["text"]) for r in cut.where(f"_part = {part} and _cut = {at}").orderBy("item", "text").collect()]


def matches(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item: str = "item_id", q: int = Q,
    window: int = WINDOW, stride: int = STRIDE, least: int = LEAST, budget: float = BUDGET,
) -> DataFrame:
    """(id, item, windows, edits, ends_at) per row and item found: windows found, fewest edits, last place in the normal form."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    schema = f"id {given.schema['id'].dataType.simpleString()}, item {benchmark.schema[item].dataType.simpleString()}, windows int, edits int, ends_at long"
    found = spark.createDataFrame([], schema)
    for part in slices(benchmark, item, text if text in benchmark.columns else "text"):
        known = Windows(part, q, window, stride, least, budget)
        sent = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for key, t in zip(batch["id"], batch["text"], strict=True):
                    of = {}
                    for name, end, edits in sent.value.found(t):
                        of.setdefault(name, []).append((edits, end))
                    rows += [(key, name, len(x), min(x)[0], max(e for _, e in x)) for name, x in of.items()]
                yield pd.DataFrame(rows, columns=["id", "item", "windows", "edits", "ends_at"])

        found = found.unionByName(given.mapInPandas(run, schema))
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", item: str = "item_id", **options) -> DataFrame:
    """(doc_id, item_id, windows, edits) per document and benchmark item found in it."""
    found = matches(docs, benchmark, id_column, item=item, **options)
    each = found.groupBy("id", "item").agg(F.max("windows").alias("windows"), F.min("edits").alias("edits"))
    return each.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", **options) -> DataFrame:
    """The input without the rows that hold a benchmark item. Rows are told apart by themselves, not by their id."""
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
    bad = stored(matches(rows, benchmark, "_row", text, item, **options).select(F.col("id").alias("_row")).distinct(), "contaminated")
    return rows.join(bad, "_row", "left_anti").select(*(rows[c] for c in docs.columns))
