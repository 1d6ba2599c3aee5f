"""Readable durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = 31_536_000
DAY = 86_400
HOUR = 3_600
MINUTE = 60


def seconds_to_units(seconds: Column) -> Column:
    """Split whole seconds into units.

    Whole 365-day years come off first; the totals and the share of a year describe what is left.
    """
    rest = F.pmod(seconds, F.lit(YEAR))
    of_day = F.pmod(rest, F.lit(DAY))

    def whole(value: Column, unit: int) -> Column:
        return F.floor(value / F.lit(unit))

    days = whole(rest, DAY)
    hours = whole(of_day, HOUR)
    minutes = whole(F.pmod(of_day, F.lit(HOUR)), MINUTE)
    secs = F.pmod(of_day, F.lit(MINUTE))

    def total(unit: int) -> Column:
        """Hundredths of a unit, half up, in whole numbers: no binary fraction decides a tie."""
        return (F.floor((rest * 200 + unit) / F.lit(2 * unit)) / 100).cast("double")

    text = F.concat_ws(
        " ",
        days.cast("string"), F.lit("days"),
        hours.cast("string"), F.lit("hours"),
        minutes.cast("string"), F.lit("minutes"),
        secs.cast("string"), F.lit("seconds"),
    )
    return F.struct(
        whole(seconds, YEAR).cast("double").alias("years"),
        days.cast("double").alias("days"),
        hours.cast("double").alias("hours"),
        minutes.cast("double").alias("minutes"),
        secs.cast("double").alias("seconds"),
        text.alias("total_time"),
        total(DAY).alias("total_time_in_days"),
        total(HOUR).alias("total_time_in_hours"),
        total(MINUTE).alias("total_time_in_minutes"),
        rest.cast("double").alias("total_time_in_seconds"),
        (F.floor((rest * 20_000 + YEAR) / F.lit(2 * YEAR)) / 100).alias("percentage_of_year"),
    )
