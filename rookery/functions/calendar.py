"""Calendar expressions over Unix seconds, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def instant(epoch_seconds: Column) -> Column:
    return F.timestamp_seconds(epoch_seconds)


def utc_date(epoch_seconds: Column) -> Column:
    return F.date_from_unix_date(F.floor(epoch_seconds / F.lit(86400)).cast("int"))


def utc_hour(epoch_seconds: Column) -> Column:
    return F.floor(F.pmod(epoch_seconds, F.lit(86400)) / F.lit(3600)).cast("int")


def utc_wall_clock(ts: Column) -> Column:
    """An instant as zone-free UTC wall-clock time."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def weekday_name(date: Column) -> Column:
    return F.date_format(date, "EEEE")


def calendar_fields(epoch_seconds: Column) -> dict[str, Column]:
    """Timestamp, date and the six calendar parts of a game end; weeks start on Sunday = 1."""
    date = utc_date(epoch_seconds)
    return {
        "game_end_timestamp": instant(epoch_seconds),
        "game_date": date,
        "game_year": F.year(date),
        "game_month": F.month(date),
        "game_day": F.dayofmonth(date),
        "game_hour": utc_hour(epoch_seconds),
        "game_day_of_week": F.dayofweek(date),
        "game_weekday_name": weekday_name(date),
    }


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM").cast("date")


def season(date: Column) -> Column:
    """Quarter label such as ``2026-Q2``."""
    return F.concat(F.year(date).cast("string"), F.lit("-Q"), F.ceil(F.month(date) / F.lit(3)).cast("string"))
