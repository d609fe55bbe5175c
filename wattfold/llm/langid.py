"""Language identification by error-correcting output codes.

Each language has a codeword; each bit is a binary classifier over hashed character 1-, 2- and 3-grams: the log-odds
of a gram between the languages whose bit is set and the others, each language weighing alike. A text's margin for a bit
is the sum of its grams' log-odds over the square root of their number, scaled so that a training text of typical
length is decided clearly. Decoding is loss-weighted: the language whose codeword has the least exponential loss against
all margins wins. The score is its share of exp(-loss); a text whose runner-up is near is flagged ambiguous.

Up to 7 languages the code is exhaustive (every split once); beyond that the columns are drawn by a fixed rule that
keeps the best of several tries by least distance. Only training is bounded: at most about ``SAMPLE`` texts per language,
taken by a hash of the text; their gram counts are summed per partition before the shuffle. The model has
bits * 2^15 numbers whatever the data.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any labelled row every text is
``und``; with one language that language has score 1; ties go to the language first by code point; repeated rows get a
row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, CELLS, CHUNK, NEAR, SHARP = 2000, 1 << 15, 1 << 20, 0.2, 4.0
_LETTER, _OTHER = re.compile(r"[^\W\d_]"), re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether a character has the category of letters; signs for numbers such as fractions are none."""
    found = _LETTER.search(text)
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, set(text))))


def grams(text: str) -> np.ndarray:
    """How often each cell of hashed grams occurs in a whole text; long texts are counted in overlapping chunks."""
    points = np.frombuffer((" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.zeros(CELLS, dtype=np.int64)
    for start in range(0, len(points), CHUNK):
        end = min(len(points), start + CHUNK)
        h = np.zeros(end - start, dtype=np.uint64)
        for n in range(1, 4):
            stop = min(end, len(points) - n + 1)
            if stop <= start:
                break
            h = h[: stop - start] * np.uint64(0x9E3779B97F4A7C15) + points[start + n - 1 : stop + n - 1].astype(np.uint64) + np.uint64(n)
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out += np.bincount((mixed >> np.uint64(49)).astype(np.int64), minlength=CELLS)
    return out


def code(k: int) -> np.ndarray:
    """Codewords of k languages, -1 and 1."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 7:
        columns = [[1 if i == 0 or not c >> (i - 1) & 1 else -1 for i in range(k)] for c in range(1, 1 << k - 1)]
        return np.array(columns, dtype=float).T
    bits, best, far = int(np.ceil(10 * np.log2(k))), None, -1
    for seed in range(50):
        tried = np.where(np.random.default_rng(seed).random((k, bits)) < 0.5, -1.0, 1.0)
        tried[0, np.abs(tried.sum(axis=0)) == k] *= -1  # every column splits
        apart = (bits - tried @ tried.T) / 2 + bits * np.eye(k)
        if apart.min() > far:
            best, far = tried, apart.min()
    return best


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", bound: int = SAMPLE) -> dict:
    """Languages, code and log-odds per bit and gram, from at most about ``bound`` texts of each language."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return {"names": [], "code": code(0), "odds": np.zeros((CELLS, 1), dtype=np.float32)}
    limit = F.create_map(*(F.lit(x) for n in names for x in (n, int(min(1.0, bound / sizes[n]) * (1 << 32)))))
    taken = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 32)) < limit[F.col("lang")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch["text"], batch["lang"], strict=True):
                if has_letter(t):
                    sums[name] = sums.get(name, 0) + grams(t)
        for name, s in sums.items():
            at = np.flatnonzero(s)
            yield pd.DataFrame({"lang": name, "cell": at, "n": s[at]})

    made = taken.mapInPandas(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    share = np.full((len(names), CELLS), 0.5)
    np.add.at(share, (np.array([names.index(x) for x in made["lang"]], dtype=int), made["cell"].to_numpy(dtype=int)), made["n"].to_numpy(dtype=float))
    share /= share.sum(axis=1, keepdims=True)
    words = code(len(names))
    odds = np.zeros((CELLS, words.shape[1]), dtype=np.float32)
    if len(names) > 1:
        for b in range(words.shape[1]):
            odds[:, b] = np.log(share[words[:, b] > 0].mean(axis=0) / share[words[:, b] < 0].mean(axis=0))
    return {"names": names, "code": words, "odds": odds}


def decode(margins: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best codeword, its share of exp(-loss), and whether the runner-up is near."""
    loss = np.exp(-np.clip(margins[:, None, :] * words[None], -3, 3)).mean(axis=2)
    shares = np.exp(-SHARP * loss)
    shares /= shares.sum(axis=1, keepdims=True)
    best = shares.argmax(axis=1)
    ordered = np.sort(shares, axis=1)
    near = ordered[:, -1] - ordered[:, -2] < NEAR if words.shape[0] > 1 else np.zeros(len(best), dtype=bool)
    return best, shares[np.arange(len(best)), best], near


def predict(docs: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns, lang_pred, score and ambiguous of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        names, words, odds = sent.value["names"], sent.value["code"], sent.value["odds"]
        lang, score, near = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        for i, t in enumerate(texts):
            if not names or not t or not has_letter(t):
                continue
            n = grams(t)
            at = np.flatnonzero(n)
            margin = (n[at] @ odds[at]) / np.sqrt(n.sum())
            best, share, close = decode(margin[None, :], words)
            lang[i], score[i], near[i] = names[best[0]], share[0], close[0]
        return pd.DataFrame({"lang": lang, "score": score, "ambiguous": near})

    made = docs.select(*(F.col(f"`{c}`") for c in keep), run(F.col(text)).alias("_made"))
    return made.select(*(F.col(f"`{c}`") for c in keep), F.col("_made.lang").alias("lang_pred"), "_made.score", "_made.ambiguous")
