"""Chat turns and replies: language, action markers, clean text, clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattfold.operators.hotkeys import first_rows

# Marker pattern, Hangul range, length limits, default answer.
MARKER = r"(?i)<{1,2}\s*(ZOOM|FILTER|RESET|TREND)\s*(?::\s*([^<>\n]+?))?\s*>{1,2}"
HANGUL = r"[가-힯]"
QUESTION_CHARS, CONTEXT_CHARS, TURN_CHARS, HISTORY_TURNS = 2000, 6000, 1200, 8
NO_REPLY = "No answer came back; ask again in other words."
_BLANKS = r"^\s+|\s+$"


def trim_blanks(text: Column) -> Column:
    """Trims line breaks and tabs too."""
    return F.regexp_replace(text, _BLANKS, "")


def chat_lang(df: DataFrame, *, text: str = "text", hint: str | None = None, default: str = "en") -> DataFrame:
    tries = [F.when(F.col(text).rlike(HANGUL), F.lit("ko"))]
    if hint is not None:
        tries.append(F.nullif(F.col(hint), F.lit("")))
    return df.withColumn("lang", F.coalesce(*tries, F.lit(default)))


def chat_actions(replies: DataFrame, *, text: str = "text") -> DataFrame:
    """One row per marker: pos (from 0 among the valid ones), type, arg.

    RESET takes no argument, the other kinds are dropped without one.
    """
    kind = F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))
    arg = F.regexp_extract_all(text, F.lit(MARKER), F.lit(2))
    pair = F.zip_with(
        kind,
        arg,
        lambda k, a: F.struct(
            F.lower(k).alias("type"),
            F.when(F.lower(k) != "reset", F.nullif(trim_blanks(a), F.lit(""))).alias("arg"),
        ),
    )
    valid = F.filter(pair, lambda p: (p["type"] == "reset") | p["arg"].isNotNull())
    keep = [c for c in replies.columns if c != text]
    return replies.select(*keep, F.posexplode(valid).alias("pos", "action")).select(
        *keep, "pos", "action.type", "action.arg"
    )


def chat_clean(replies: DataFrame, *, text: str = "text", default: str = NO_REPLY) -> DataFrame:
    """Reply without markers; a default text when nothing is left."""
    clean = trim_blanks(F.regexp_replace(F.coalesce(text, F.lit("")), MARKER, ""))
    return replies.withColumn("answer", F.coalesce(F.nullif(clean, F.lit("")), F.lit(default)))


def whitelist(actions: DataFrame, allowed: DataFrame) -> DataFrame:
    """Keeps resets and the actions whose (type, arg) is allowed.

    A semi join over the plain list: it needs no distinct, and a pair that many actions
    share can be split by the adaptive skew join.
    """
    listed = allowed.select("type", F.col("arg").alias("_arg"))
    reset = actions.sparkSession.range(1).select(F.lit("reset").alias("type"), F.lit("").alias("_arg"))
    keyed = actions.withColumn("_arg", F.coalesce("arg", F.lit("")))
    return keyed.join(listed.unionByName(reset), ["type", "_arg"], "left_semi").select(*actions.columns)


def chat_history(
    turns: DataFrame,
    *,
    by: str = "conv_id",
    order: str = "turn",
    n: int = HISTORY_TURNS,
    chars: int = TURN_CHARS,
) -> DataFrame:
    """Last n turns per conversation; of those the non-empty user and assistant turns, clipped."""
    last = first_rows(turns, by=[by], order=[F.desc(order)], n=n).drop("_rank")
    return last.filter(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != "")).withColumn(
        "text", F.substring("text", 1, chars)
    )


def chat_clip(requests: DataFrame, *, question: str = "question", context: str | None = "context") -> DataFrame:
    """Questions without text are refused; question and context are clipped."""
    out = requests.filter(F.coalesce(question, F.lit("")) != "").withColumn(
        question, F.substring(question, 1, QUESTION_CHARS)
    )
    if context is None:
        return out
    return out.withColumn(context, F.substring(F.coalesce(context, F.lit("")), 1, CONTEXT_CHARS))
