"""Quality by hierarchical empirical Bayes.

A logistic classifier over the shape of a text gives each document its own evidence. Above it stands a tree of sites
(host, then path within the host): the summed evidence of a site is shrunk towards its parent, the host towards the
whole corpus, with a prior strength that the method of moments finds from how much sites really differ. A document's
verdict adds to its own log-odds what its site's posterior, made without the document itself, says beyond the corpus.

Sums per site are partially aggregated before the shuffle, so a hot site is no hot task; its documents get them by a
broadcast of at most ``SITES`` rows, or else by a join on salted keys. Only the classifier is fitted on a sample: at
most about ``SAMPLE`` labelled rows, taken by a hash of the text.

Defined cases: null and empty texts have no words and get the features of an empty text; null hosts and paths are
sites of their own; documents labelled twice count with each label; without labels of both kinds every document has
evidence 0.5; repeated rows and ids count as documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattfold.llm.graph import stored

SAMPLE, SITES, SALT, CLIP = 20_000, 50_000, 64, 6.0
#: Share of a site's log-odds that reaches its documents. A site is a hint: it decides only where the text does not.
TRUST = 0.25
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> list[float]:
    """Figures of a whole text that do not depend on its language or length (but for the last, its logarithm)."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    tokens = Counter(text.split())  # what a token says is asked once for each different one
    n, w = max(1, len(text)), max(1, tokens.total())
    words = _WORD.findall(text)
    letters = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(k for x, k in tokens.items() if x.isupper())
    marks = sum(k for x, k in tokens.items() if not x[-1].isalnum())
    spoken = sum(k for x, k in tokens.items() if x.isalpha() or any(map(str.isalpha, x)))
    digits = sum(text.count(c) for c in set(text) if c.isdigit())
    squeezed = len(zlib.compress(raw, 1)) / max(1, len(raw))
    return [
        letters / n,
        digits / n,
        upper / w,
        marks / w,
        spoken / w,
        np.log1p(letters / max(1, len(words))),
        len({x.lower() for x in tokens}) / w**0.75,
        len(set(lines)) / max(1, len(lines)),
        min(squeezed, 1.5),
        text.count("!") / w,
        sum(text.count(c) for c in "|<>{}[]#*%=_~") / w,
        np.log1p(w / max(1, len(lines))),
        np.log1p(w),
    ]


N_FEATURES = len(features(""))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> dict:
    """Logistic regression by Newton steps over standardised features and their squares, both classes weighing alike."""
    if len(set(y.tolist())) < 2:
        return {"mean": np.zeros(N_FEATURES), "scale": np.ones(N_FEATURES), "beta": np.zeros(2 * N_FEATURES + 1)}
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    model = {"mean": mean, "scale": scale, "beta": np.zeros(2 * N_FEATURES + 1)}
    design = expand(x, model)
    weight = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y <= 0).mean()) / len(y)
    penalty = np.full(design.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ model["beta"], -30, 30)))
        gradient = design.T @ (weight * (p - y)) + penalty * model["beta"]
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        model["beta"] = model["beta"] - step
        if np.abs(step).max() < 1e-8:
            break
    return model


def expand(x: np.ndarray, model: dict) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -5, 5)
    return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)


def learn(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, bound: int = SAMPLE) -> dict:
    """The classifier, from about ``bound`` labelled rows at most, chosen by a hash of the text."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_y")).where("_y is not null and _id is not null")
    n = known.count()
    part = min(1.0, bound / max(1, n))
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).where(F.pmod(F.xxhash64("_text"), F.lit(1 << 32)) < int(part * (1 << 32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_x": [features(t) for t in batch["_text"]], "_y": batch["_y"]})

    made = rows.join(known, "_id").select("_text", "_y").mapInPandas(run, "_x array<double>, _y double")
    got = made.toPandas()
    x, y = np.array(got["_x"].tolist()).reshape(-1, N_FEATURES), got["_y"].to_numpy(dtype=float)
    order = np.lexsort([y, *x.T[::-1]])  # sums do not depend on the order of arrival
    return fit(x[order], y[order])


def evidence(docs: DataFrame, model: dict, text: str = "text", column: str = "doc_p") -> DataFrame:
    """The input and the classifier's probability of each row."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)
        return pd.Series(1 / (1 + np.exp(-np.clip(expand(x, model) @ model["beta"], -CLIP, CLIP))))

    return docs.withColumn(column, score(F.col(text)))


def _strength(sites: DataFrame, mean: str) -> float:
    """Prior strength by the method of moments: n large and sites alike gives a strong prior, sites apart a weak one."""
    between = F.sum(F.expr(f"n * pow(s / n - {mean}, 2)"))
    within = F.sum(F.expr("ss - s * s / n"))
    row = sites.agg(between.alias("b"), within.alias("w"), F.count("*").alias("k"), F.sum("n").alias("n"), F.expr("sum(n * n) / sum(n)").alias("m")).first()
    if not row["n"] or row["k"] < 2 or row["n"] <= row["k"]:
        return 10.0
    inner = row["w"] / (row["n"] - row["k"])
    outer = max(0.0, (row["b"] - (row["k"] - 1) * inner) / max(1e-9, row["n"] - row["m"]))
    return float(min(1e4, max(1.0, inner / outer if outer > 0 else 1e4)))


def posteriors(scored: DataFrame, host: str = "host", path: str = "path", column: str = "doc_p") -> DataFrame:
    """One row per (host, path): sums of its evidence, the host's without it, prior strengths and the global mean."""
    sums = [F.count("*").alias("n"), F.sum(column).alias("s"), F.sum(F.col(column) * F.col(column)).alias("ss")]
    paths = stored(scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    whole = hosts.agg(F.coalesce(F.expr("sum(s) / sum(n)"), F.lit(0.5))).first()[0]
    host_strength = _strength(hosts, repr(float(whole)))
    of_host = hosts.select(F.col("host").alias("_host"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    both = paths.join(of_host, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    path_strength = _strength(both, "host_s / host_n")
    return both.withColumns({"base": F.lit(float(whole)), "host_strength": F.lit(host_strength), "path_strength": F.lit(path_strength)})


def judge(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id_column: str = "doc_id", text: str = "text",
    label: str = "quality", trust: float = TRUST, cut: float = 0.5, keep: list[str] | None = None,
) -> DataFrame:
    """(``keep`` columns, doc_p, site_p, score, accepted) per row; accepted where the score reaches ``cut``."""
    keep = [id_column] if keep is None else keep
    model = learn(docs, labels, id_column, text, label)
    given = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_kept"), F.col(text).alias("_text"), F.col(host).cast("string").alias("_host"), F.col(path).cast("string").alias("_path")
    )
    scored = stored(evidence(given, model, "_text", "_p").drop("_text"), "evidence")
    sites = stored(posteriors(scored, "_host", "_path", "_p"), "sites")
    same = F.col("_host").eqNullSafe(F.col("host")) & F.col("_path").eqNullSafe(F.col("path"))
    if sites.count() <= SITES:
        rows = scored.join(F.broadcast(sites), same)
    else:
        salted = scored.withColumn("_salt", F.pmod(F.hash(F.monotonically_increasing_id()), F.lit(SALT)))
        spread = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = salted.join(spread, same & (F.col("_salt") == F.col("salt")))
    odds = "ln(greatest({0}, 1e-6) / greatest(1 - {0}, 1e-6))"
    rows = (
        rows.withColumn("host_p", F.expr("(host_s - _p + host_strength * base) / (host_n - 1 + host_strength)"))
        .withColumn("site_p", F.expr("(s - _p + path_strength * host_p) / (n - 1 + path_strength)"))
        .withColumn("logit", F.expr(f"{odds.format('_p')} + {float(trust)} * ({odds.format('site_p')} - {odds.format('base')})"))
        .withColumn("score", F.expr("1 / (1 + exp(-logit))"))
    )
    return rows.select("_kept.*", F.col("_p").alias("doc_p"), "site_p", "score", (F.col("score") >= cut).alias("accepted"))


def accept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of the input that are accepted, with the input's columns."""
    kept = docs.withColumn("_whole", F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    return judge(kept, labels, keep=["_whole"], **options).where("accepted").select("_whole.*")
