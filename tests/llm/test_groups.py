"""Near duplicates, nearest neighbours, mixing, extraction, chat and the pipeline against plain versions."""

import hashlib
import itertools
import sys
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from wattfold.llm import ann, extract, graph, mixing, shingles, simhash  # noqa: E402
from wattfold.llm import queries as Q  # noqa: E402


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_near_duplicates_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs]
    rows += [(10_000 + i, r["text"][:-3] + " zz") for i, r in enumerate(docs[:30])] + [(20_000, None), (20_001, ""), (20_002, "one two")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps, 2)
    want = {(d, f"{f:016x}", min(rows[j][0] for j in range(len(rows)) if roots[j] == r)) for (d, _), f, r in zip(rows, fps, roots, strict=True)}
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


def test_cut_buckets_lose_no_link(spark):
    rng = np.random.default_rng(1)
    fps = sorted({int(x) & ~0xFFFF for x in rng.integers(0, 1 << 40, 5)} | {int(rng.integers(0, 1 << 9)) << 20 for _ in range(200)})
    frame = spark.createDataFrame([(0, f) for f in fps], "plane int, fp long")
    got = {(r["a"], r["b"]) for r in simhash.links(frame, 2, bucket=8).collect()}
    parts = plain_components(fps, 2)
    place = {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in got:
        root[max(find(place[a]), find(place[b]))] = min(find(place[a]), find(place[b]))
    assert [find(i) for i in range(len(fps))] == parts


def test_cut_buckets_end_at_radius_4(spark):
    """Few free bits: every mask adds a bit, and any four free bits stay free in one of them."""
    for n in range(5, 33):
        mask = (1 << 64) - (1 << n)  # the low n bits are free
        made = simhash.cover(mask, 4)
        assert all(m & mask == mask and m != mask for m in made)
        for free in itertools.combinations(range(n), 4) if n < 16 else ():
            assert any(not (m ^ mask) & sum(1 << b for b in free) for m in made)
    rng = np.random.default_rng(2)
    fps = sorted({int(x) << 3 for x in rng.integers(0, 1 << 15, 60)})
    got = simhash.links(spark.createDataFrame([(0, f) for f in fps], "plane int, fp long"), 4, bucket=24).collect()
    place, root = {f: i for i, f in enumerate(fps)}, list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in got:
        a, b = sorted((find(place[r["a"]]), find(place[r["b"]])))
        root[b] = a
    assert [find(i) for i in range(len(fps))] == plain_components(fps, 4)


def test_the_highest_bit_counts_as_one(spark):
    fps = [5, 5 - (1 << 63), 4 - (1 << 63), 1 << 40]
    for radius in (2, 4):
        got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(0, f) for f in fps], "plane int, fp long"), radius).collect()}
        assert {x for pair in got for x in pair} == set(fps[: 3 if radius == 2 else 4])


def plain_shingles(text):
    words = (text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("tile", [256, 7])
def test_copies_down_to_the_bound_are_found(spark, monkeypatch, tile):
    """Pairs with shingle similarity 0.8 to 0.9 become one document, pairs below 0.8 stay two; one group is a chain."""
    monkeypatch.setattr(shingles, "TILE", tile)
    rng = np.random.default_rng(4)
    texts, word = [], lambda: f"w{rng.integers(1 << 40):x}"
    for k in range(160):
        words = [word() for _ in range(200)]
        other = words[: 200 - (10 + k % 20)] + [word() for _ in range(10 + k % 20)]  # 0.74 to 0.9
        texts += [" ".join(words), " ".join(other)]
    chain = [word() for _ in range(200)]
    for _ in range(40):  # each one is near the one before
        chain = chain[4:] + [word() for _ in range(4)]
        texts.append(" ".join(chain))
    texts += [None, ""]
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i for i in range(len(texts)) if find(i) == i}
    got = {r["doc_id"] for r in shingles.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert want <= got and len(got - want) <= 2, (len(want), len(got - want))


def test_fingerprints_make_candidates(spark):
    """Without any min-hash, copies within the radius of a fingerprint are found through the covering masks, and checked."""
    rng = np.random.default_rng(8)
    texts, word = [], lambda: f"w{rng.integers(1 << 40):x}"
    for k in range(60):
        words = [word() for _ in range(300)]
        for cut in (2, 5 + k):  # 0.96, and 0.95 to 0.63
            texts.append(" ".join(words[:-cut] + [word() for _ in range(cut)]))
        texts.append(" ".join(words))
    sets = [shingles.shingles(t, 5) for t in texts]
    prints = [simhash.majority(h, shingles.PLANES) for h in sets]
    near = [[min((a ^ b).bit_count() for a, b in zip(p, q, strict=True)) <= shingles.RADIUS for q in prints] for p in prints]
    good = [[near[i][j] and shingles.similarity(sets[i], sets[j]) >= shingles.LEAST for j in range(len(texts))] for i in range(len(texts))]
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string").repartition(2)
    nodes = shingles.printed(rows, "text", 5).withColumn("_keys", F.array().cast("array<bigint>")).drop("text").cache()
    place = {bytes(r["_set"]): r["_row"] for r in nodes.collect()}
    found = {place[bytes(r["node"])]: place[bytes(r["root"])] for r in shingles.groups(nodes, rows, 2, 5).collect()}
    found = [found.get(i, i) for i in range(len(texts))]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if good[i][j]]
    assert len(pairs) > 50 and all(found[i] == found[j] for i, j in pairs)
    assert all(i // 3 == r // 3 for i, r in enumerate(found))


def plain_nearest(rows, k):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if v and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 50 == 0:
            s = sorted((-float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), j) for j, w in good if j != i)
            out[i] = [j for _, j in s[:k]]
    return out


@pytest.mark.parametrize("kind", ["long", "binary", "struct<plane:int,fp:bigint>"])
def test_components_take_two_shuffles_a_round(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 150, (90, 2))] + [(400 - i, 399 - i) for i in range(40)]
    edges += [(900, 500 + i) for i in range(60)] * 2 + [(i, 600) for i in range(601, 660)] + [(7, 7)]  # hubs at either end, repeated edges
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    made, write = [], graph.stored

    def stored(frame, name):
        made.append(frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return write(frame, name)

    monkeypatch.setattr(graph, "stored", stored)
    node = {"long": lambda x: x, "binary": lambda x: x.to_bytes(2, "big"), "struct<plane:int,fp:bigint>": lambda x: (x % 2, x)}[kind]
    got = [(r["node"], r["root"]) for r in graph.components(spark.createDataFrame([(node(a), node(b)) for a, b in edges], f"u {kind}, v {kind}")).collect()]
    least = {}
    for x in root:
        least[find(x)] = min(least.get(find(x), node(x)), node(x))
    assert {(node(x), least[find(x)]) for x in root} == {tuple(bytes(y) if kind == "binary" else tuple(y) if kind[0] == "s" else y for y in r) for r in got}
    assert len(got) == len(root) and len(made) > 2 and max(made) <= 2
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_set_of_texts_is_held_at_a_time(spark, monkeypatch):
    import weakref

    alive, most, plain = weakref.WeakSet(), [0], shingles.shingles

    class Held(np.ndarray):
        __hash__ = object.__hash__

    def counted(text, size):
        made = plain(text, size).view(Held)
        alive.add(made)
        most[0] = max(most[0], len(alive))
        return made

    class Docs:
        columns, schema = ["text"], spark.createDataFrame([], "text string").schema

        def mapInArrow(self, run, schema):
            import pyarrow as pa

            return list(run([pa.RecordBatch.from_pydict({"text": [f"word {i} of many more words {i}" for i in range(50)] + [None]})]))

    monkeypatch.setattr(shingles, "shingles", counted)
    (batch,) = shingles.printed(Docs(), "text", 5)
    assert batch.num_rows == 51 and batch.column(2).to_pylist()[-1] == [] and most[0] <= 3


def test_neighbours_recall(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows += [(9000 + i, rows[0][1]) for i in range(60)]
    rows += [(8001, None), (8002, [0.0] * 64), (8003, [float("nan")] * 64), (8050, [None] * 64), (None, rows[1][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = plain_nearest([tuple(r) for r in frame.collect()], 5)
    got = {}
    for r in ann.search(frame, frame.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values())) >= 0.9
    assert got[0] == [9000, 9001, 9002, 9003, 9004] or got[0][:5] == want[0]


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_neighbours_recall_of_the_query(spark, size):
    path = Path("/root/testdata") / size
    if not path.exists():
        pytest.skip("no test tables here")
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in Q.op6_multiprobe_ann(spark, str(path)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for i in np.flatnonzero(ids % 50 == 0):
        near = x @ x[i]
        near[i] = -2
        hits += len(got[ids[i]] & set(ids[np.argsort(-near)[:5]].tolist()))
    assert hits >= 0.9 * 5 * len(got)


def test_few_neighbours_are_scanned(spark):
    rows = [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, -1.0]), (50, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(frame, frame.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, 2), (0, 3, 1), (50, 1, 0), (50, 2, 2), (50, 3, 1)]
    assert ann.search(frame.where("false"), frame.where("false")).count() == 0


def test_probes_come_in_order():
    place = np.array([0.1, 2.6, -1.3])
    got = ann.probes(place, 27)
    assert len(set(got)) == 27 and got[0] == (0, 2, -2)
    cost = lambda b: sum(0 if s == 0 else (x - np.floor(x)) ** 2 if s < 0 else (1 - (x - np.floor(x))) ** 2 for x, s in zip(place, np.array(b) - np.floor(place), strict=True))
    assert [cost(b) for b in got] == sorted(cost(b) for b in got)


def test_mix_takes_near_target(spark, sf_dir):
    got = Q.op5_source_mixing(spark, sf_dir).toPandas()
    assert (got["taken"] <= 3 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(by["taken"] - by["target"]) <= 0.01 * by["size"] + 2).all()
    odd = spark.createDataFrame([(1, None, None), (1, "a", ""), (None, None, "x y")], "doc_id long, source string, text string")
    assert mixing.mix(odd).count() == 3 and mixing.mix(odd.where("false")).count() == 0


def test_chat_reads_back(spark, sf_dir):
    got = {r["conv_id"]: r for r in Q.op10_chat_formatting(spark, sf_dir).collect()}
    turns = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert got.keys() == turns.keys()
    for c, rows in turns.items():
        loss = "".join(t for role, t in rows if role == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(rows), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_extraction_gives_a_row_per_page(spark, sf_dir):
    got = Q.op9_html_extraction(spark, sf_dir).toPandas()
    assert len(got) == spark.read.parquet(f"{sf_dir}/pages.parquet").count() and got["page_id"].is_unique
    assert (got["n_chars"] == got["text"].map(len)).all() and not got["text"].str.contains("<script|track\\(", regex=True).any()


def test_extraction_of_other_languages_and_wrappers():
    for line in ("Москва является столицей России и крупнейшим городом страны с населением более двенадцати миллионов человек. ", "北京是中华人民共和国的首都,也是全国的政治文化中心和国际交往中心。" * 4):
        page = f"<body><nav><a href=x>меню</a></nav><div><p>{line * 3}</p><p>{line}</p></div><ul><li><a href=y>{line}</a></li></ul></body>"
        assert extract.main_text(page) == f"{line * 3}".strip() + " " + line.strip()
    text = "The river is long and it was on the way to the sea that they had seen it for a while. " * 4
    for wrapper in ("with-sidebar", "no-sidebar", "has-header", "sidebar page"):
        assert extract.main_text(f"<div class='{wrapper}'><article><p>{text}</p></article></div>") == text.strip()
    assert extract.main_text(f"<div class='no-sidebar'><p>{text}</p></div>") == text.strip()
    assert extract.main_text(f"<article><p>{text}</p></article><div class=related><article><p>{text}</p></article></div>") == text.strip()
    assert extract.main_text(f"<article><p>{text}İİİİ</p><SCRIPT>var a = '<b>';</Script><p>{text}</p></article>") == f"{text}İİİİ {text}".strip()


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows(spark, sf_dir, at):
    name, stage = corpus_pipeline.STAGES[at]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", None, "s", 5), (5, "word " * 20_000, "en", "s", 1)]
    odd = spark.createDataFrame(rows, shape)
    for docs in (odd, odd.where("false")):
        made = stage(spark, docs, sf_dir)
        made.collect()
        if at < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == docs.columns


def test_pipeline_keeps_clean_rows(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert got.join(labels.where("quality = 0"), "doc_id", "left_semi").count() == 0
    assert got.count() > 0.7 * spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    taken = {r["doc_id"] for r in got.collect()}
    from wattfold.llm import decontam

    bad = decontam.contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert not taken & {r["doc_id"] for r in bad.collect()}


def test_lines_of_the_article_that_are_links_stay():
    page = "<nav><a href=x>Home of the site with a long menu entry</a></nav><article><p>" + "The text of the article is here and it is long. " * 6
    page += "</p><ul><li><a href=y>A list entry of the article that is a link as a whole</a></li></ul><p><a href=z>One more</a></p></article><p><a href=q>Elsewhere</a></p>"
    text = extract.main_text(page)
    assert "A list entry of the article" in text and text.endswith("One more") and "Home" not in text
