from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wattfold.functions import names
from wattfold.operators import chat, votes


def vote_rows(spark, rows):
    return spark.createDataFrame(rows, "building string, ts timestamp_ntz, vote string, seq bigint")


def test_tally_shares_and_feed(spark):
    at = datetime(2026, 1, 1, 12)
    rows = [("a", at - timedelta(minutes=10 * i), v, i) for i, v in enumerate(["hot", "hot", "ok"])]
    rows += [("b", at, "cold", 10), ("c", at, "hot", 11), ("c", at, "cold", 12), ("a", at - timedelta(hours=2), "cold", 13)]
    cast = vote_rows(spark, rows)
    tally = votes.vote_tally(cast, as_of="2026-01-01 12:00:00").cache()
    assert {r["building"]: (r["hot"], r["ok"], r["cold"], r["total"], r["status"]) for r in tally.collect()} == {
        "a": (2, 1, 0, 3, "too_hot"), "b": (0, 0, 1, 1, "too_cold"), "c": (1, 0, 1, 2, "ok"),
    }
    assert tally.filter("hot + ok + cold <> total").count() == 0
    assert votes.vote_overview(tally).first()[:] == (6, 3, 1, 1)
    shares = {r["building"]: (r["hot_pct"], r["ok_pct"], r["cold_pct"]) for r in votes.vote_shares(tally).collect()}
    assert shares["a"] == (67.0, 33.0, 0.0) and shares["b"] == (0.0, 0.0, 100.0)
    exact = {r["building"]: r["hot_pct"] for r in votes.vote_shares(tally, whole=False).collect()}
    assert abs(exact["a"] - 200 / 3) < 1e-9
    feed = votes.recent_votes(cast, tally, n=2).collect()
    assert [(r["building"], r["seq"]) for r in feed] == [("a", 0), ("a", 1)]
    assert votes.vote_overview(tally.limit(0)).first()[:] == (0, 0, 0, 0)


REPLIES = [
    (1, "Here. <<ZOOM:hall>>", [("zoom", "hall")], "Here."),
    (2, "<FILTER:Science>>\n", [("filter", "Science")], chat.NO_REPLY),
    (3, "x << filter : Science > y", [("filter", "Science")], "x  y"),
    (4, "<<RESET>><<RESET:now>> ok", [("reset", None), ("reset", None)], "ok"),
    (5, "<<ZOOM>> <<TREND: >> none", [], "none"),
    (6, "no marker", [], "no marker"),
    (7, "<<ZOOM:nowhere>> <<trend:lab>>\n<<FILTER:Other>>", [("zoom", "nowhere"), ("trend", "lab"), ("filter", "Other")], chat.NO_REPLY),
    (8, None, [], chat.NO_REPLY),
]


def test_actions_and_clean_text(spark):
    rows = spark.createDataFrame([(i, t) for i, t, _, _ in REPLIES], "id int, text string")
    got = {}
    for r in chat.chat_actions(rows).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["type"], r["arg"]))
    assert {i: a for i, _, a, _ in REPLIES if a} == got
    clean = {r["id"]: r["answer"] for r in chat.chat_clean(rows).collect()}
    assert clean == {i: c for i, _, _, c in REPLIES}
    allowed = spark.createDataFrame([("zoom", "hall"), ("trend", "lab"), ("filter", "Science"), ("filter", "Science")], "type string, arg string")
    kept = chat.whitelist(chat.chat_actions(rows), allowed)
    assert sorted((r["id"], r["type"]) for r in kept.collect()) == [(1, "zoom"), (2, "filter"), (3, "filter"), (4, "reset"), (4, "reset"), (7, "trend")]


def test_language(spark):
    rows = spark.createDataFrame([("안녕", None), ("hello", "fr"), ("hello", ""), ("hello", None)], "text string, hint string")
    assert [r["lang"] for r in chat.chat_lang(rows, hint="hint").collect()] == ["ko", "fr", "en", "en"]


def test_history_is_cut_before_it_is_filtered(spark):
    turns = [(1, i, "system" if i % 2 else "user", "x" * 1500) for i in range(10)] + [(1, 10, "assistant", "")]
    got = chat.chat_history(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")).orderBy("turn").collect()
    assert [(r["turn"], len(r["text"])) for r in got] == [(4, 1200), (6, 1200), (8, 1200)]


def test_clip(spark):
    rows = spark.createDataFrame([("q" * 2500, "c" * 7000), ("", "c"), (None, "c"), ("q", None)], "question string, context string")
    assert [(len(r["question"]), len(r["context"])) for r in chat.chat_clip(rows).collect()] == [(2000, 6000), (1, 0)]


KNOWN = {"Old Mill Hall": "Mill", "Tower": "TWR", "Tower Annex": "Annex"}


def test_short_names(spark):
    rows = ["Old Mill Hall", " Tower ", "Tower Annex", "The Tower West", "Old Mill", "Plain Hall", "Plain Library Hall", "Plain Hall Center", "", None]
    df = spark.createDataFrame([(n,) for n in rows], "n string")
    got = [r[0] for r in df.select(names.short_name(F.col("n"), KNOWN)).collect()]
    assert got == ["Mill", "TWR", "Annex", "TWR", "Mill", "Plain", "Plain", "Plain Hall", "?", "?"]
    simple = [r[0] for r in df.filter("n <> ''").select(names.simple_name(F.col("n"), KNOWN)).collect()]
    assert simple[5:] == ["Plain", "Plain Library", "Plain"]
    nice = spark.createDataFrame([("big_blue_hall",), ("hq",)], "i string").select(names.nice_name(F.col("i"), {"hq": "Head Quarters"}))
    assert [r[0] for r in nice.collect()] == ["Big Blue Hall", "Head Quarters"]
