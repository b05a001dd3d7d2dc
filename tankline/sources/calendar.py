"""Two-shift calendars: shift 1 of a day starts at 20:45 the evening before,
shift 2 at 08:45."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wall_clock_ms

SHIFT_SECONDS = 43_200
_HALF_DAY = "interval 12 hours"


def _shift_floor(wall: Column) -> Column:
    """Start of the shift in which a wall-clock time lies."""
    moved = wall + F.expr("interval 3 hours 15 minutes")
    night = F.date_trunc("day", moved) - F.expr("interval 3 hours 15 minutes")
    return F.when(F.hour(moved) < 12, night).otherwise(night + F.expr(_HALF_DAY))


def _labelled(starts: DataFrame) -> DataFrame:
    evening = F.hour("shiftstart") == 20
    return starts.select(
        "shiftstart",
        F.when(evening, F.date_add(F.to_date("shiftstart"), 1))
        .otherwise(F.to_date("shiftstart"))
        .alias("shiftdate"),
        F.when(evening, 1).otherwise(2).alias("shift"),
        F.lit(None).cast("int").alias("crew"),
    )


def calendar_between(bounds: DataFrame) -> DataFrame:
    """Every shift from the one before ``first`` to the one after ``last``.

    ``bounds`` has one row of two zoneless timestamps, ``first`` and ``last``.
    """
    low = (_shift_floor(F.col("first")) - F.expr(_HALF_DAY)).cast("timestamp_ntz")
    high = (_shift_floor(F.col("last")) + F.expr(_HALF_DAY)).cast("timestamp_ntz")
    starts = bounds.filter(F.col("first").isNotNull()).select(
        F.explode(F.sequence(low, high, F.expr(_HALF_DAY))).alias("shiftstart")
    )
    return _labelled(starts)


def calendar_of(readings: DataFrame) -> DataFrame:
    """The shifts that cover a table of readings."""
    return calendar_between(
        readings.agg(
            F.timestamp_millis(F.min("time_created")).cast("timestamp_ntz").alias("first"),
            F.timestamp_millis(F.max("time_created")).cast("timestamp_ntz").alias("last"),
        )
    )


def wide_calendar(shifts: DataFrame, seconds: int = SHIFT_SECONDS) -> DataFrame:
    """Add ``length`` and ``shiftstart_epoch`` where the calendar lacks them."""
    if "length" not in shifts.columns:
        shifts = shifts.withColumn("length", F.lit(seconds))
    if "shiftstart_epoch" not in shifts.columns:
        epoch = F.call_function("div", wall_clock_ms(F.col("shiftstart")), F.lit(1000))
        shifts = shifts.withColumn("shiftstart_epoch", epoch)
    return shifts
