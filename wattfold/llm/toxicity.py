"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are labelled rows, at most about ``EXAMPLES`` per label, taken by a hash of the text. Vectors have the terms
(words and stems) whose presence speaks most clearly for or against the label among the examples (G-squared above ``CLEAR``, at most
``TERMS``); document frequencies count all documents. The index holds the examples in blocks with the greatest weight of
each term in each block. A query's bound on a block is the sum of its weights times these maxima; blocks are scored from
the highest bound down until no bound is above the k-th best similarity, so the neighbours are exact. Neighbours vote
with weights that fall with distance, and a logistic curve fitted on the examples themselves (each without itself and
its copies) makes the vote a calibrated probability. The nearest examples and shared terms are the evidence.

Index and curve have a fixed bound on their size; documents are neither shuffled nor joined.

Defined cases: null and empty texts, and texts without any of the terms, have no neighbours and get the calibrated
score of a vote at the prior; null labels are not learned from; without labels of both kinds every score is the share of
label 1, or 0 without labels; ties between neighbours go to the example that comes first in the index; repeated rows
get a row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattfold.llm.graph import stored

EXAMPLES, TERMS, CLEAR, BLOCK, NEAREST, PRIOR = 3000, 512, 30.0, 64, 15, 1.0
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> Counter:
    """Words, and the first four to six letters of longer words as stems (written with a tilde)."""
    words = Counter(_WORD.findall((text or "").lower()))
    out = Counter(words)
    for word, n in words.items():
        for size in STEMS:
            if len(word) > size:
                out[word[:size] + "~"] += n
    return out


def clarity(n0: np.ndarray, n1: np.ndarray, totals: tuple[float, float]) -> np.ndarray:
    """G-squared of a term's presence against the label, from the examples of each label that have it."""
    have, n = np.stack([n0, n1], axis=1).astype(float), np.array(totals, dtype=float)
    share = have.sum(axis=1, keepdims=True) / n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.nan_to_num(have * np.log(have / (n * share))) + np.nan_to_num((n - have) * np.log((n - have) / (n * (1 - share))))).sum(axis=1)


def clear_terms(held: DataFrame, at_least: float = CLEAR, most: int = TERMS) -> list[str]:
    """The terms of the examples (y, bag) whose presence depends most on the label; none without examples of both labels."""
    n = {r["y"]: r["n"] for r in held.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return []
    totals = (n[0], n[1])
    g = F.pandas_udf(lambda a, b: pd.Series(clarity(a.to_numpy(), b.to_numpy(), totals)), "double")
    each = held.select("y", F.explode("bag.t").alias("t")).groupBy("t").agg(F.count_if(F.expr("y = 0")).alias("n0"), F.count_if(F.expr("y = 1")).alias("n1"))
    best = each.select("t", g("n0", "n1").alias("g")).where(F.col("g") >= at_least).orderBy(F.desc("g"), "t").limit(most)
    return sorted(r["t"] for r in best.collect())


class Index:
    """Examples in blocks, and the greatest weight of each term in each block."""

    def __init__(self, names: list[str], idf: np.ndarray, bags: list[Counter], y: np.ndarray, block: int = BLOCK, kin: list | None = None):
        self.number, self.names, self.idf, self.block = {t: i for i, t in enumerate(names)}, names, idf, block
        vectors = [self.vector(b) for b in bags]
        # examples with like vectors side by side: tight maxima
        order = sorted(range(len(bags)), key=lambda i: (vectors[i][0].tolist(), i))
        order = [i for i in order if len(vectors[i][0])]
        same: dict = {}  # examples with the same words, known by ``kin`` where the bags hold the index's terms only
        self.kin = np.array([same.setdefault(x, i) for i, x in enumerate(kin or [frozenset(b.items()) for b in bags])], dtype=np.int64)
        self.kin_at = self.kin[order]
        self.y = np.asarray(y, dtype=float)[order]
        self.prior = float(np.mean(y)) if len(y) else 0.0
        blocks = -(-len(order) // block)
        self.most = np.zeros((len(names), blocks))
        self.weights = [np.zeros((len(names), min(block, len(order) - b * block)), dtype=np.float32) for b in range(blocks)]
        for at, i in enumerate(order):
            where, w = vectors[i]
            self.weights[at // block][where, at % block] = w
            self.most[where, at // block] = np.maximum(self.most[where, at // block], w)
        self.most *= 1 + 1e-6  # above rounding

    def vector(self, bag: Counter) -> tuple[np.ndarray, np.ndarray]:
        known = sorted((self.number[t], n) for t, n in bag.items() if t in self.number)
        where = np.array([i for i, _ in known], dtype=np.int64)
        w = np.array([1 + np.log(n) for _, n in known]) * self.idf[where] if known else np.zeros(0)
        return where, (w / np.linalg.norm(w) if len(w) else w)

    def nearest(self, bag: Counter, k: int = NEAREST, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples with any shared term; ``without``: an example, left out with its copies."""
        where, w = self.vector(bag)
        best_at, best = np.zeros(0, dtype=np.int64), np.zeros(0)
        if not len(where) or not self.weights:
            return best_at, best
        bound = w @ self.most[where]
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(best) >= k and bound[b] < best[-1]):
                break
            cosine = np.round(w @ self.weights[b][where], 6)
            at = np.arange(len(cosine)) + b * self.block
            if without >= 0:
                cosine = np.where(self.kin_at[at] == self.kin[without], 0.0, cosine)
            best_at, best = np.concatenate([best_at, at[cosine > 0]]), np.concatenate([best, cosine[cosine > 0]])
            order = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[order], best[order]
        return best_at, best

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        weight = cosine**2 / (0.05 + np.sqrt(np.maximum(0.0, 2 - 2 * cosine)))  # many far neighbours don't outvote the prior
        return float((weight @ self.y[at] + PRIOR * self.prior) / (weight.sum() + PRIOR))


def _curve(votes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic calibration of votes (slope and offset over their log-odds), with a ridge towards slope 1 and offset 0: votes near 0 and 1 alone would make it a step."""
    x = np.stack([_logit(votes), np.ones(len(votes))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 5.0 * np.eye(2), x.T @ (weight * (p - y)) + 5.0 * (beta - [1.0, 0.0]))
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def examples(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, bound: int) -> DataFrame:
    """(y, bag, kin, weight): at most about ``bound`` labelled rows of each label. ``kin`` is the digest of the whole bag,
    ``weight`` what a row stands for."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and _id is not null")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = {y: min(1.0, bound / n) for y, n in counts.items()}
    mark = F.pmod(F.xxhash64("text"), F.lit(1 << 32))
    cuts = F.expr(f"case y when 0 then {int(part.get(0, 1) * (1 << 32))}L else {int(part.get(1, 1) * (1 << 32))}L end")
    rows = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.where(mark < int(max(part.values(), default=1) * (1 << 32))).join(known, "_id").where(mark < cuts)

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [sorted(terms(t).items()) for t in batch["text"]]
            kin = [hashlib.sha256(repr(b).encode("utf-8", "surrogatepass")).hexdigest() for b in made]
            yield pd.DataFrame({"y": batch["y"], "bag": made, "kin": kin})

    held = rows.select("y", "text").mapInPandas(bags, "y int, bag array<struct<t string, n long>>, kin string")
    return held.withColumn("weight", F.when(F.col("y") == 0, 1 / part.get(0, 1.0)).otherwise(1 / part.get(1, 1.0)))


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = EXAMPLES):
    """The index and the calibration curve. Of the examples' bags, only the terms of the index reach the driver."""
    spark = docs.sparkSession
    held = stored(examples(docs, labels, id_column, text, label, bound), "examples")
    names = clear_terms(held)
    used = F.filter("bag", lambda x: x["t"].isin(names) if names else F.lit(False))
    got = held.select("y", "kin", "weight", used["t"].alias("t"), used["n"].alias("n")).toPandas()
    got = got.sort_values(["kin", "y"], kind="stable").reset_index(drop=True)
    y = got["y"].to_numpy(dtype=float)
    bags = [Counter(dict(zip(t, n, strict=True))) for t, n in zip(got["t"], got["n"], strict=True)]
    sent = spark.sparkContext.broadcast(set(names))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, seen = 0, Counter()
        for batch in batches:
            for t in batch["text"]:
                n += 1
                seen.update(sent.value.intersection(terms(t)))
        yield pd.DataFrame([("", n), *seen.items()], columns=["term", "n"])

    df = {r["term"]: r["n"] for r in docs.select(F.col(text).alias("text")).mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    idf = np.array([np.log((1 + df.get("", 0)) / (1 + df.get(t, 0))) + 1 for t in names])
    index = Index(names, idf, bags, y, kin=got["kin"].tolist())
    weight = got["weight"].to_numpy(dtype=float)
    if len(y):
        index.prior = float(weight @ y / weight.sum())
    votes = np.array([index.vote(*index.nearest(b, without=i)) for i, b in enumerate(bags)])
    curve = _curve(votes, y, weight / weight.mean()) if names else (1.0, 0.0)
    return index, curve


def score(docs: DataFrame, model, id_column: str = "doc_id", text: str = "text", k: int = NEAREST) -> DataFrame:
    """(id, score, neighbours, toxic_neighbours, nearest_cosine, evidence) per row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    schema = f"id {given.schema['id'].dataType.simpleString()}, score double, neighbours int, toxic_neighbours int, nearest_cosine double, evidence array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, (slope, offset) = sent.value
        for batch in batches:
            out = []
            for key, t in zip(batch["id"], batch["text"], strict=True):
                bag = terms(t)
                at, cosine = index.nearest(bag, k)
                if index.names:
                    p = 1 / (1 + np.exp(-(slope * _logit(index.vote(at, cosine)) + offset)))
                else:
                    p = index.prior
                shared = [index.names[i] for i in index.vector(bag)[0]]
                out.append((key, float(p), len(at), int(index.y[at].sum()), float(cosine.max(initial=0.0)), shared))
            yield pd.DataFrame(out, columns=["id", "score", "neighbours", "toxic_neighbours", "nearest_cosine", "evidence"])

    return given.mapInPandas(run, schema)
