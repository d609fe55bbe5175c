"""Source divergence audit: how far each source's use of terms is from every other source and from its language.

A group is a (lang, source). Smoothed shares p = 1 + floor(UNIT * (count + 1) / (N + V)) of the language's V kept terms
are whole numbers, and f(p, q) = floor((p - q)^2 / q). The sum of f over all terms for a pair of groups falls into parts:

* as if no group had any term: V * f(p0, q0), with the shares p0, q0 of a count of zero;
* what one group's own terms change, the other at zero: a sum over the distinct counts of a group;
* what terms in both groups change beyond that: the pair corrections.

Corrections come from a frequent-pattern tree per language. A kept term is a row of its nonzero counts in source order;
equal rows are counted first, and a row is inserted with its multiplicity. A node is a (source, count) below its
prefix, so terms that share a prefix share its nodes, and each combination of a node and an ancestor is worked out
once, times the node's multiplicity. Rows are dealt by ranges of (lang, row): neighbours share prefixes and no prefix is
bound to one task. A tree that has grown to ``NODES`` nodes hands its sums on and a new one starts; multiplicities add
up, so neither cut changes a sum. Within a tree one step works on all nodes with their ancestors of the same distance.

Terms are counted in the tasks that read the documents (per group and term, handed on at ``HELD`` entries), then
added up per (lang, term): a frequent term or a hot source is one row per task. Pairs of groups are the result itself;
no other pairs are made. Integers of up to 63 bits are split in two before they are added up, sums are decimals.

Defined cases: null text, lang and source are ''; each row is a document, repeated rows and ids too; a group without
terms has counts of zero; a language without kept terms has V = 0, its pairs the value 0; equal values are ordered by
item; a language with one source has no pairs; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattfold.llm.scratch import folder, written

LEAST_DOCS, TOP_TERMS, UNIT = 3, 200, 1_000_000_000
HELD, NODES, CHUNK = 1_000_000, 400_000, 1_000
#: A-Z lowered; what is neither a letter of ASCII nor beyond ASCII becomes a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of letters of ASCII and of any character beyond it; bytes, as no character of UTF-8 mixes the two."""
    return text.translate(_BYTES).split()


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): partial counts of the tasks."""
    given = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (tongue, site), (n, seen) in held.items():
            names = list(n)
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                size = len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tongue] * size, pa.string()),
                        pa.array([site] * size, pa.string()),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([n[t] for t in part], pa.int64()),
                        pa.array([seen[t] for t in part], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        since = 0
        for batch in batches:
            whole = batch.column(2).cast(pa.binary())
            for tongue, site, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), whole, strict=True):
                found = terms(data.as_py())
                n, seen = held.setdefault((tongue, site), (Counter(), Counter()))
                size = len(n)
                n.update(found)
                seen.update(set(found))
                since += len(n) - size
                if since > HELD:
                    yield from rows(held)
                    held, since = {}, 0
        yield from rows(held)

    return given.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: str, total: str) -> Column:
    """p of a count; null where the language has no kept term."""
    return F.expr(f"case when v > 0 then (cast({count} + 1 as decimal(20,0)) * {UNIT}) div cast({total} + v as decimal(20,0)) + 1 end")


def chi(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def kept_terms(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, term, total, uses: (source, n) in order of source) of the terms in at least LEAST_DOCS documents."""
    uses = counted(docs, text, lang, source).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    each = F.sort_array(F.collect_list(F.struct("source", "n")))
    return uses.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), each.alias("uses")).where(F.col("docs") >= LEAST_DOCS).drop("docs")


class Tree:
    """A frequent-pattern tree: parent, group and shares of each node, and how many terms pass it."""

    def __init__(self) -> None:
        self.child: dict[tuple, int] = {}
        self.parent: list[int] = []
        self.item: list[tuple] = []  # sid, p, p0
        self.times: list[int] = []

    def insert(self, row: list[tuple], times: int) -> None:
        at = -1
        for item in row:
            node = self.child.setdefault((at, item), len(self.parent))
            if node == len(self.parent):
                self.parent.append(at)
                self.item.append(item)
                self.times.append(0)
            self.times[node] += times
            at = node

    def corrections(self) -> dict[tuple[int, int], int]:
        """(sid of p, sid of q): sum over all combinations of a node and an ancestor, in both directions."""
        if not self.parent:
            return {}
        parent, times = np.array(self.parent), np.array(self.times, dtype=np.int64)
        sid, p, p0 = (np.array(column, dtype=np.int64) for column in zip(*self.item, strict=True))
        width = int(sid.max()) + 1
        out: Counter = Counter()
        node, above = np.arange(len(parent)), parent
        while (has := above >= 0).any():
            node, above = node[has], above[has]
            for a, b in ((node, above), (above, node)):
                value = _f(p[a], p[b]) - _f(p[a], p0[b]) - _f(p0[a], p[b]) + _f(p0[a], p0[b])
                pairs, group = np.unique(sid[a] * width + sid[b], return_inverse=True)
                # 31 bits of the value times a multiplicity below 2^31 stay in a long; so do their sums over NODES in Python
                high, low = value >> 31, value & ((1 << 31) - 1)
                order = np.argsort(group, kind="stable")
                starts = np.searchsorted(group[order], np.arange(len(pairs)))
                for pair, hi, lo in zip(pairs.tolist(), _added(high * times[node], order, starts), _added(low * times[node], order, starts), strict=True):
                    out[divmod(pair, width)] += (hi << 31) + lo
            above = parent[above]
        return out


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _added(values: np.ndarray, order: np.ndarray, starts: np.ndarray) -> list[int]:
    """Sums of the groups, free of overflow: upper and lower halves apart."""
    high, low = np.add.reduceat((values >> 32)[order], starts), np.add.reduceat((values & 0xFFFFFFFF)[order], starts)
    return [(h << 32) + x for h, x in zip(high.tolist(), low.tolist(), strict=True)]


def pair_corrections(rows: DataFrame) -> DataFrame:
    """From (lang, path: (sid, p, p0), times): (lang, a, b, value), partial sums of the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Tree] = {}
        size = 0

        def sums() -> Iterator[pa.RecordBatch]:
            for tongue, tree in trees.items():
                made = list(tree.corrections().items())
                columns = [[tongue] * len(made), [a for (a, _), _ in made], [b for (_, b), _ in made], [str(v) for _, v in made]]
                types = [pa.string(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "a", "b", "value"])

        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                tongues, times = part.column(0).to_pylist(), part.column(2).to_pylist()
                for tongue, row, n in zip(tongues, part.column(1).to_pylist(), times, strict=True):
                    if tongue not in trees:
                        trees[tongue] = Tree()
                    tree = trees[tongue]
                    before = len(tree.parent)
                    tree.insert([(x["sid"], x["p"], x["p0"]) for x in row], n)
                    size += len(tree.parent) - before
                if size > NODES:
                    yield from sums()
                    trees, size = {}, 0
        yield from sums()

    return rows.select("lang", "path", "times").mapInArrow(run, "lang string, a int, b int, value string")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", *, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` (all other sources) and ``term`` (the ``top`` terms over-used)."""
    spark = docs.sparkSession
    home = folder(spark, "divergence")
    kept = written(kept_terms(docs, text, lang, source), f"{home}/terms")
    tongues = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    used = kept.select("lang", "term", "total", F.explode("uses").alias("use")).select("lang", "term", "total", "use.source", "use.n")
    sizes = used.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    everyone = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    groups = everyone.join(sizes, ["lang", "source"], "left").join(tongues, "lang", "left").na.fill(0, ["group_n", "v", "lang_n"])
    groups = groups.withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source"))).withColumn("p0", share("0L", "group_n"))
    groups = written(groups, f"{home}/groups")

    facts = groups.select("lang", "source", "sid", "group_n", "v", "lang_n", "p0")
    shares = used.join(facts, ["lang", "source"]).withColumn("p", share("n", "group_n"))
    shares = shares.withColumn("q", share("total", "lang_n"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(chi("p", "q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    paths = shares.repartition("lang", "term").groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("sid", "p", "p0"))).alias("path"))
    rows = written(paths.groupBy("lang", "path").agg(F.count("*").alias("times")), f"{home}/rows")
    dealt = rows.where(F.size("path") > 1).repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    both = pair_corrections(dealt).select("lang", "a", "b", F.col("value").cast("decimal(38,0)").alias("value"))

    alone = rows.select("lang", "times", F.explode("path").alias("x")).groupBy("lang", "x.sid", "x.p", "x.p0").agg(F.sum("times").alias("times"))
    other = groups.select("lang", F.col("sid").alias("other"), F.col("p0").alias("q0"))
    met = alone.join(other, "lang").where("sid <> other")
    times = F.col("times").cast("decimal(20,0)")
    mine = met.select("lang", F.col("sid").alias("a"), F.col("other").alias("b"), (times * F.expr(f"{chi('p', 'q0')} - {chi('p0', 'q0')}")).cast("decimal(38,0)").alias("value"))
    theirs = met.select("lang", F.col("other").alias("a"), F.col("sid").alias("b"), (times * F.expr(f"{chi('q0', 'p')} - {chi('q0', 'p0')}")).cast("decimal(38,0)").alias("value"))

    left = groups.select("lang", "source", F.col("sid").alias("a"), "v", "p0")
    right = groups.select("lang", F.col("source").alias("item"), F.col("sid").alias("b"), F.col("p0").alias("q0"))
    pairs = left.join(right, "lang").where("a <> b")
    changes = both.unionAll(mine).unionAll(theirs).groupBy("lang", "a", "b").agg(F.sum("value").alias("change"))
    base = F.coalesce(F.expr(f"cast(v as decimal(20,0)) * {chi('p0', 'q0')}"), F.lit(0)).cast("decimal(38,0)")
    value = (base + F.coalesce("change", F.lit(0).cast("decimal(38,0)"))).cast("long")
    apart = pairs.join(changes, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    apart = apart.withColumn("rank", F.row_number().over(best))
    return apart.unionByName(over)
