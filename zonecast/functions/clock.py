"""Time columns. All timestamps are TIMESTAMP_NTZ: local before conversion, UTC after it.

Only interval arithmetic and ``convert_timezone`` are used, so no result depends on the
session time zone.
"""

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonecast.settings import TIMEZONE


def epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def instant(value: str | datetime | Column) -> Column:
    """A TIMESTAMP_NTZ literal from text or a naive datetime."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def hours(count) -> Column:
    """An interval of whole hours."""
    one = F.expr("interval '1' hour")
    return one * (count if isinstance(count, Column) else F.lit(count))


def hour_index(ts: Column) -> Column:
    """Whole hours since 1970 (not before it)."""
    gap = ts - epoch()
    return (F.extract(F.lit("DAY"), gap) * 24 + F.extract(F.lit("HOUR"), gap)).cast("bigint")


def hour_floor(ts: Column) -> Column:
    return epoch() + hours(hour_index(ts))


def elapsed_hours(later: Column, earlier: Column) -> Column:
    """Elapsed hours as a double, fractions kept."""
    gap = later - earlier
    return (
        F.extract(F.lit("DAY"), gap).cast("double") * 24
        + F.extract(F.lit("HOUR"), gap).cast("double")
        + F.extract(F.lit("MINUTE"), gap).cast("double") / 60
        + F.extract(F.lit("SECOND"), gap).cast("double") / 3600
    )


def is_hour(ts: Column) -> Column:
    return ts == hour_floor(ts)


def to_local(ts: Column, zone: str = TIMEZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def to_utc(ts: Column, zone: str = TIMEZONE) -> Column:
    """UTC of an unambiguous local time, e.g. a local midnight."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def strict_utc(ts: Column, zone: str = TIMEZONE) -> Column:
    """UTC of a local time, or NULL when the local time is skipped or happens twice."""
    utc = to_utc(ts, zone)
    skipped = to_local(utc, zone) != ts
    repeated = (to_local(utc + hours(1), zone) == ts) | (to_local(utc - hours(1), zone) == ts)
    return F.when(~skipped & ~repeated, utc)


def resolved(frame, column: str = "hour", zone: str = TIMEZONE):
    """Replace a local hour by its UTC hour and drop rows without one.

    The one-element explode is a barrier: without it Spark pushes filters on the UTC hour below
    the aggregation that made the hours, and the zone arithmetic would run once per raw row.
    """
    made = frame.withColumn("_utc", F.explode(F.array(strict_utc(F.col(column), zone))))
    kept = [F.col("_utc").alias(column) if c == column else F.col(c) for c in frame.columns]
    return made.where(F.col("_utc").isNotNull()).select(*kept)


def day_text(ts: Column) -> Column:
    return ts.cast("date").cast("string")


def month_text(ts: Column) -> Column:
    return F.substring(day_text(ts), 1, 7)
