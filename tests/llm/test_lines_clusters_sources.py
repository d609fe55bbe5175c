"""Line dedup, centroid clustering and the source audit against plain versions, and their odd inputs."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from wattfold.llm import centroids, divergence, linededup

SPACE = " \t\n\x0b\f\r"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# --- line dedup -----------------------------------------------------------------------


def plain_lines(rows):
    """(id, text) rows to sorted (id, n_lines, n_dropped, kept); a null id is the last document."""
    rank = lambda i: (i is None, i or 0)
    owner = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            k = lowered(line.strip(SPACE))
            if len(k) >= 10:
                owner[k] = min(owner.get(k, rank(i)), rank(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if owner.get(lowered(x.strip(SPACE)), rank(i)) == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows(n=300, seed=4):
    rng = random.Random(seed)
    pool = [f"{w} line of the pool, number {i}" for i in range(40) for w in ("A", "ÄÖ", "x")]
    rows = []
    for i in range(n):
        lines = ["Common line in a third of all" if rng.random() < 0.34 else f"own line {i} of its document"]
        lines += [rng.choice([x, x.upper(), f" \t{x}\x0b ", x.lower()]) for x in rng.choices(pool, k=rng.randrange(6))]
        lines += rng.choices(["", "short", "123456789", "0123456789", " nbsp is no blank here ", "twice here twice"], k=3)
        rng.shuffle(lines)
        rows.append((i * 3, "\n".join(lines)))
    return rows


ODD_LINES = [(None, None), (None, "Common line in a third of all\nonly without id, only"), (5_000, ""), (5_001, "\n\n"), (0, "only without id, only\r\nagain again again"),
             (7, "twice the same row\ntwice the same row"), (7, "twice the same row\ntwice the same row"), (9, "twice the same row")]


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_lines_match_the_plain_version(spark, batches):
    rows = line_rows() + ODD_LINES + [(8_000, "\n".join(f"row {i % 3000} of a very long text" for i in range(20_000))), (8_001, "w" * 2_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, linededup.deduplicate(docs, batches=batches).collect()), key=repr)
    assert got == plain_lines(rows)


def test_lines_of_batches_go_to_the_first_batch(spark):
    store = linededup.LineRuns(spark, buckets=3, fanout=2)
    kept = []
    for i in range(5):
        rows = [(100 - i, f"the same in every batch\nonly in batch {i} {i}"), (200 - i, f"only in batch {max(i - 2, 0)} {max(i - 2, 0)}")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        kept += [tuple(r) for r in linededup.strip(docs, store.absorb(linededup.lines_of(docs))).select("doc_id", "n_dropped").collect()]
        levels = Counter(level for level, _ in store.runs)
        assert max(levels.values()) < 2, "a full level is compacted"
        hashes = [r["h"] for _, t in store.runs for r in spark.table(t).where("not old").collect()]
        assert len(hashes) == len(set(hashes)), "runs are disjoint"
    assert sorted(kept) == [(96, 1), (97, 1), (98, 1), (99, 1), (100, 0), (196, 1), (197, 1), (198, 1), (199, 1), (200, 1)]
    store.close()


def test_lines_of_an_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.deduplicate(empty).collect() == []
    docs = spark.createDataFrame([(1, "a line of some length"), (2, "A LINE of some length")], "doc_id long, text string")
    for extra in ("h", "pos", "tx", "id", "batch", "_gone", "owner", "old", "n", "key", "_id", "_tx", "_at", "_text", "_lines"):
        docs = docs.selectExpr("*", f"'x' {extra}")
    assert [tuple(r) for r in linededup.deduplicate(docs, batches=1).orderBy("doc_id").collect()] == [(1, 1, 0, "a line of some length"), (2, 1, 1, "")]


def test_runs_are_read_without_a_shuffle(spark):
    store = linededup.LineRuns(spark, buckets=4)
    lines = linededup.lines_of(spark.createDataFrame(line_rows(50), "doc_id long, text string"))
    store.absorb(lines)
    from pyspark.sql import functions as F

    run = store._run(store.runs[0][1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lines.groupBy("h").agg(F.min("id")).repartition(4, "h").join(run, "h", "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 2  # of the batch's keys only
    store.close()


# --- centroid clustering --------------------------------------------------------------


def plain_clusters(rows, k=16, rounds=3, dims=64, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [list(v) for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(at)), key=lambda j: (far(v, at[j]), j))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)].append(v)
        for j, vs in groups.items():
            at[j] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    won = [(i, near(v), far(v, at[near(v)])) for i, v in kept]
    inertia = Counter()
    for _, j, d in won:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, j, d in won), key=repr)


def test_clusters_match_the_plain_version(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) if i % 3 else rng.uniform(-2, 2) for _ in range(64)]) for i in range(250)]
    rows += [(i, rows[1][1]) for i in range(300, 380)] + [(3, rows[3][1]), (None, rows[5][1])]  # a group of copies: empty clusters, ties
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [math.nan] + [0.0] * 63), (906, [math.inf] + [0.0] * 63)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    assert sorted(map(tuple, centroids.cluster(frame).collect()), key=repr) == plain_clusters(rows)


def test_a_tie_goes_to_the_smaller_number():
    import numpy as np

    winner, distance = centroids.Bisectors([[4, 0], [0, 4], [4, 0], [-4, 0]]).nearest(np.array([[2, 2], [0, 0], [4, 0], [-5, 1], [0, 9]]))
    assert winner.tolist() == [0, 0, 0, 3, 1] and distance.tolist() == [8, 16, 0, 2, 25]


def test_few_vectors_and_none(spark):
    frame = spark.createDataFrame([(i, [float(i)] * 64, "x") for i in range(3)], "vec_id long, embedding array<double>, cluster string")
    assert sorted(map(tuple, centroids.cluster(frame).collect()), key=repr) == plain_clusters([(i, [float(i)] * 64) for i in range(3)])
    empty = centroids.cluster(frame.where("vec_id < 0").select("vec_id", "embedding"))
    assert empty.collect() == [] and empty.columns == centroids.cluster(frame).columns
    assert centroids.cluster(frame.selectExpr("*", *[f"'x' {c}" for c in ("id", "v", "n", "far", "total", "distance")])).count() == 3


def test_too_large_components_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1e12] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(frame)


# --- source audit ---------------------------------------------------------------------


def plain_audit(rows, top=200):
    """(lang, source, text) rows, by the plain sum over all terms."""
    used, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in lowered(text or "")).split(" ")
        found = [t for t in found if t]
        groups[lang].add(source)
        used[lang, source].update(found)
        seen[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= 3)
        v = len(kept)

        def shares(counts, kept=kept, v=v):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + v) for t in kept}

        p = {s: shares(used[lang, s]) for s in sources}
        q = shares(sum((used[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            over = [("term", t, f(p[s][t], q[t])) for t in kept if used[lang, s][t] and p[s][t] > q[t]]
            for part in (pairs, over):
                part.sort(key=lambda r: (-r[2], r[1].encode()))
                out += [(lang, s, *r, i + 1) for i, r in enumerate(part) if r[0] == "pair" or i < top]
    return sorted(out)


def audit_rows(n=400, seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "über", "Straße", "naïve", "дом", "a", "b", "rare", "żółw", "x1y", "don't", "東京"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(n):
        source = "s0" if rng.random() < 0.34 else f"s{rng.randrange(1, 9)}"
        rows.append((rng.choice(["en", "de", "de", None]), rng.choice([source, source, None]), rng.choice([" ", "-", "\n", "9"]).join(rng.choices(words, k=rng.randrange(12)))))
    return rows + [("xx", "only", "no term three times"), ("yy", "a", None), ("yy", "b", ""), ("zz", "a", "t t"), ("zz", "a", "t"), ("zz", "b", "t")] + rows[:9]


@pytest.mark.parametrize("nodes", [3, divergence.NODES])
def test_audit_matches_the_plain_sum(spark, monkeypatch, nodes):
    monkeypatch.setattr(divergence, "NODES", nodes)
    monkeypatch.setattr(divergence, "CHUNK", 2)
    monkeypatch.setattr(divergence, "HELD", 20)
    rows = audit_rows()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == plain_audit(rows)


def test_audit_keeps_the_top_terms_only(spark):
    rows = [("en", f"s{i % 2}", " ".join(f"t{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(300) if i % 2 or j % 3)) for i in range(8)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = sorted(map(tuple, divergence.audit(docs, top=5).collect()))
    assert got == plain_audit(rows, 5)


def test_audit_of_an_empty_table_and_clashing_names(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
    rows = [("en", "a", "t t"), ("en", "b", "t"), ("en", "b", "t u")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    docs = docs.selectExpr("*", *[f"'x' {c}" for c in ("term", "n", "docs", "sid", "p", "q", "part", "item", "value", "rank", "v", "p0")])
    assert sorted(map(tuple, divergence.audit(docs).collect())) == plain_audit(rows)


def test_a_shared_path_is_one_combination(spark):
    tree = divergence.Tree()
    tree.insert([(1, 10, 2), (2, 7, 3)], 5)
    tree.insert([(1, 10, 2), (2, 7, 3), (4, 9, 1)], 1)
    assert len(tree.parent) == 3 and tree.times == [6, 6, 1]
    f = lambda p, q: (p - q) ** 2 // q
    assert tree.corrections()[1, 2] == 6 * (f(10, 7) - f(10, 3) - f(2, 7) + f(2, 3))
    assert tree.corrections()[4, 1] == f(9, 10) - f(9, 2) - f(1, 10) + f(1, 2)


def test_large_sums_do_not_overflow():
    tree = divergence.Tree()
    big = 10**9 + 1
    for _ in range(3):
        tree.insert([(1, big, 1), (2, big, 1)], 10**9)
    f = lambda p, q: (p - q) ** 2 // q
    assert tree.corrections()[1, 2] == 3 * 10**9 * (f(big, big) - 2 * f(big, 1) + f(1, 1) + f(big, 1) - f(1, big))
