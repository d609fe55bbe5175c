"""Cleaning of raw exports: error rows, number parsing, dialects, kW resolution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattfold.functions.rounding import half_even

# Accepted range of a load and of any other measure.
KW_MIN, KW_MAX = 0.0, 50_000.0
MEASURE_LIMIT = 1e8
_OTHER_LETTERS = "[a-df-zA-DF-Z]"  # a number has no letter but the e of its exponent


def parse_number(text: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    return F.when(~text.rlike(_OTHER_LETTERS), text.try_cast("double"))


def safe_float(df: DataFrame, cols: Sequence[str], *, limit: float = MEASURE_LIMIT, digits: int = 3) -> DataFrame:
    """Parses ``cols``; unparsable and oversized values become null."""
    parsed = df.withColumns({c: parse_number(F.col(c)) for c in cols})
    return parsed.withColumns({c: F.when(F.abs(F.col(c)) <= limit, half_even(f"`{c}`", digits)) for c in cols})


def drop_error_rows(df: DataFrame, *, error: str = "error") -> DataFrame:
    """Keeps rows whose error flag is the integer 0; no flag counts as 0."""
    if error not in df.columns:
        return df
    flag = F.trim(F.coalesce(F.col(error), F.lit("0")))
    return df.filter(F.when(flag.rlike(r"^[+-]?[0-9]+$"), flag.try_cast("bigint")) == 0)


def require(df: DataFrame, col: str = "kw") -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def any_measure_present(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    return df.filter(F.coalesce(*[F.col(m) for m in measures]).isNotNull())


Dialect = Mapping[str, str]


def normalize(
    df: DataFrame,
    dialect: Dialect | Sequence[tuple[Column, Dialect]],
    keep: Sequence[Column | str],
    measures: Sequence[str],
    *,
    cells: str | None = None,
) -> DataFrame:
    """Source headers to canonical measures; a measure the dialect or file lacks is null.

    Sources are columns, or entries of the map column ``cells``. Several dialects come as (condition, dialect), the
    first condition that holds decides; the rows are read once.
    """
    have = set(df.columns)
    choices = [(None, dialect)] if isinstance(dialect, Mapping) else list(dialect)

    def source(header: str | None) -> Column:
        if header is not None and cells is not None:
            return F.try_element_at(cells, F.lit(header))
        return F.col(f"`{header}`") if header in have else F.lit(None).cast("string")

    def measure(name: str) -> Column:
        text = F.lit(None).cast("string")
        for condition, names in reversed(choices):
            found = source(names.get(name))
            text = found if condition is None else F.when(condition, found).otherwise(text)
        return text.alias(name)

    return safe_float(df.select(*keep, *[measure(m) for m in measures]), measures)


def _in_range(text: Column, lo: float, hi: float) -> Column:
    value = parse_number(text)
    return F.when((value > lo) & (value < hi), value)


def resolve_kw(
    raw: DataFrame,
    *,
    candidates: Sequence[str],
    lo: float = KW_MIN,
    hi: float = KW_MAX,
    name: str = "kw",
    cells: str | None = None,
) -> DataFrame:
    """First candidate column with a value in (lo, hi), else the first other column
    whose name says kW but not kWh, in file order."""
    if cells is not None:
        tries = [_in_range(F.try_element_at(cells, F.lit(c)), lo, hi) for c in candidates]
        loads = F.map_filter(cells, lambda k, _: F.contains(k, F.lit("kW")) & ~F.contains(k, F.lit("kWh")))
        values = F.filter(F.transform(F.map_values(loads), lambda v: _in_range(v, lo, hi)), lambda v: v.isNotNull())
        tries.append(F.try_element_at(values, F.lit(1)))
    else:
        named = [c for c in candidates if c in raw.columns]
        other = [c for c in raw.columns if "kW" in c and "kWh" not in c]
        tries = [_in_range(F.col(f"`{c}`"), lo, hi) for c in (*named, *other)]
    first = F.coalesce(*tries) if tries else F.lit(None).cast("double")
    return raw.withColumn(name, first).withColumn(name, half_even(f"`{name}`", 1))


def on_day(df: DataFrame, *, as_of: str, ts: str = "ts") -> DataFrame:
    """Rows of the day ``as_of`` as a range on ``ts``, so that the scan can prune."""
    day = F.lit(as_of).cast("date").cast(df.schema[ts].dataType)
    return df.filter((F.col(ts) >= day) & (F.col(ts) < day + F.expr("INTERVAL 1 DAY")))


def lookback(df: DataFrame, *, as_of: str, hours: float, ts: str = "ts") -> DataFrame:
    """Rows in the ``hours`` up to ``as_of``."""
    end = F.lit(as_of).cast(df.schema[ts].dataType)
    start = end - F.make_dt_interval(mins=F.lit(int(hours * 60)))
    return df.filter((F.col(ts) >= start) & (F.col(ts) <= end))


def sniff_html(df: DataFrame, *, payload: str, name: str = "rejected", chars: int = 200) -> DataFrame:
    """Marks payloads that are a web page (an expired login) instead of an export."""
    return df.withColumn(name, F.contains(F.lower(F.substring(payload, 1, chars)), F.lit("<html")))
