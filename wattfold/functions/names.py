"""Display names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes dropped from the end of a name, one of each, in this order.
NAME_SUFFIXES = (" Hall", " Center", " Building", " Library")
LEGACY_MARK = " (Legacy)"


def strip_legacy(name: Column) -> Column:
    return F.replace(name, F.lit(LEGACY_MARK), F.lit(""))


def short_name(name: Column, known: Mapping[str, str]) -> Column:
    """Exact entry, else the first entry that contains or is contained in the name, else no suffix.

    ``known`` is a short fixed list in priority order, so the match is a projection
    and needs no join. Empty names give ``?``.
    """
    trimmed = F.trim(name)
    exact = [F.when(trimmed == full, short) for full, short in known.items()]
    loose = [
        F.when(F.contains(trimmed, F.lit(full)) | F.contains(F.lit(full), trimmed), short)
        for full, short in known.items()
    ]
    plain = trimmed
    for suffix in NAME_SUFFIXES:
        plain = F.regexp_replace(plain, f"{suffix}$", "")
    return F.when(name.isNull() | (name == ""), "?").otherwise(F.coalesce(*exact, *loose, plain))


def simple_name(name: Column, known: Mapping[str, str]) -> Column:
    """Exact entry, else the first `` Hall`` and the first `` Center`` removed."""
    exact = [F.when(name == full, short) for full, short in known.items()]
    plain = name
    for word in NAME_SUFFIXES[:2]:
        at = F.instr(plain, word)
        plain = F.when(
            at > 0,
            F.concat(F.substring(plain, F.lit(1), at - 1), F.substring(plain, at + len(word), F.length(plain))),
        ).otherwise(plain)
    return F.coalesce(*exact, plain)


def nice_name(identifier: Column, known: Mapping[str, str]) -> Column:
    """Known name, else underscores to blanks and each word capitalised."""
    exact = [F.when(identifier == key, name) for key, name in known.items()]
    return F.coalesce(*exact, F.initcap(F.replace(identifier, F.lit("_"), F.lit(" "))))
