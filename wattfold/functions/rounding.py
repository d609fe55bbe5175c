"""Rounding and exact sums.

Two rules are needed to match printed figures digit for digit:

* ``half_even``: decimal rounding of the exact binary value, ties to even
  (what Python's ``round`` does). Spark's ``round`` works on the shortest
  decimal text of a double, so 1.005 becomes 1.01 there and 1.0 here.
* ``half_up``: ``floor(x * 10**d + 0.5) / 10**d`` (what JavaScript's
  ``Math.round`` idiom does).

Sums must not depend on the order in which partitions are merged, so they are taken over
integers. ``exact_total`` adds up doubles as they are, without any error before the last
rounding. ``units`` turns cleaned readings, which have three decimals at most, into whole
numbers where one integer per value is enough (short frames, sums of squares).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

READING_DIGITS = 3  # cleaned readings carry at most three decimals
_SPLIT = 134217729  # 2**27 + 1, splits a double into two exact halves
_WHOLE = 4503599627370496  # 2**52: doubles from here on have no fraction


# The functions below take SQL text: a column name, or a short expression. One parsed
# expression costs the driver far less than fifty column calls.


def half_even(x: str, digits: int = 0) -> Column:
    """Round to ``digits`` decimals, exact ties to even.

    ``x`` appears several times in the result, so a long expression should be a column first.
    """
    scale = f"{10**digits}D"
    scaled = f"(({x}) * {scale})"
    # Error of the product (x split into exact halves); it decides only where the rounded
    # product looks like a tie.
    head = f"(({x}) * {_SPLIT}D - (({x}) * {_SPLIT}D - ({x})))"
    error = f"(({head} * {scale} - {scaled}) + (({x}) - {head}) * {scale})"
    return F.expr(
        f"CASE WHEN abs({scaled}) >= {_WHOLE}D THEN {x} "
        f"WHEN abs({scaled} - rint({scaled})) = 0.5D THEN rint({scaled} + signum({error}) * 0.25D) / {scale} "
        f"ELSE rint({scaled}) / {scale} END"
    )


def half_up(x: str, digits: int = 0) -> Column:
    """Round to ``digits`` decimals, ties upwards."""
    scale = f"{10**digits}D"
    scaled = f"(({x}) * {scale})"
    return F.expr(
        f"CASE WHEN {scaled} - floor({scaled}) >= 0.5D THEN floor({scaled}) + 1D ELSE double(floor({scaled})) END / {scale}"
    )


def units(x: str, digits: int = READING_DIGITS) -> Column:
    """A reading as a whole number of 10**-digits steps."""
    return F.expr(f"floor(({x}) * {10**digits}D + 0.5D)")


def from_units(total: Column, count: Column | None = None, digits: int = READING_DIGITS) -> Column:
    """Units back to a double, divided by ``count`` in the same single division."""
    scale = F.lit(float(10**digits))
    return total.cast("double") / (scale if count is None else scale * count.cast("double"))


_PART = 1 << 26


def exact_parts(x: str) -> tuple[str, str, str]:
    """A double as whole part and two 26-bit parts of the fraction, all bigint.

    Sums of the parts are exact and stay in range for 10**11 rows of 10**7 each.
    """
    scaled = f"((({x}) - floor({x})) * {_PART}D)"
    return f"floor({x})", f"floor({scaled})", f"floor(({scaled} - floor({scaled})) * {_PART}D)"


def join_parts(whole: str, high: str, low: str) -> str:
    """Sums of parts back to the double nearest to the exact total."""
    carried = f"({high} + shiftright({low}, 26))"
    fraction = f"double(({carried} & {_PART - 1}) * {_PART} + ({low} & {_PART - 1})) / {float(_PART) ** 2:.1f}D"
    return f"(double({whole} + shiftright({carried}, 26)) + {fraction})"


def _total(x: str, keep: str | None) -> str:
    where = f" FILTER (WHERE {keep})" if keep else ""
    return join_parts(*[f"sum({part}){where}" for part in exact_parts(f"double({x})")])


def exact_total(x: str, keep: str | None = None, *, empty: float | None = None) -> Column:
    """Aggregate: sum of ``x`` (where ``keep``); ``empty`` without rows."""
    total = _total(x, keep)
    return F.expr(total if empty is None else f"coalesce({total}, {empty}D)")


def exact_mean(x: str, keep: str | None = None) -> Column:
    """Aggregate: exact total over count, one rounding each; null without rows."""
    count = f"count({x})" + (f" FILTER (WHERE {keep})" if keep else "")
    return F.expr(f"{_total(x, keep)} / nullif({count}, 0)")


def truthy(x: Column) -> Column:
    """A reading that counts: neither null nor zero."""
    return x.isNotNull() & (x != 0)
