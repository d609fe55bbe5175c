"""Calendar helpers that work on TIMESTAMP and TIMESTAMP_NTZ alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def in_zone(ts: Column, tz: str) -> Column:
    """UTC wall-clock to the wall-clock of ``tz``."""
    if tz.upper() == "UTC":
        return ts
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz"))


def meter_time_to_utc(text: Column, tz: str = "US/Pacific") -> Column:
    """Meter export time (local wall-clock text) to UTC, null when it does not parse."""
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), tz)


def iso_time(text: Column) -> Column:
    """ISO text, with or without ``Z``; null when it does not parse."""
    return F.replace(text, F.lit("Z"), F.lit("")).try_cast("timestamp_ntz")


def weekday(ts: Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(ts)


def weekday_class(day: Column) -> Column:
    return F.when(day >= 5, "weekend").otherwise("weekday")


def clock_label(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def seconds(df: DataFrame, ts: str) -> Column:
    """Whole seconds on a scale that never runs backwards when ``ts`` runs forwards."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(ts)
    if isinstance(kind, T.TimestampNTZType):
        day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
        return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    if isinstance(kind, T.DateType):
        return F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
    return F.floor(F.col(ts)).cast("bigint")
