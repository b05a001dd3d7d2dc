"""Checks on the stored tables: counts, extremes, distinct values, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import epoch_ms_to_ts, epoch_second_range
from .resample import resample_avg


def bucket_count(
    readings: DataFrame, minutes: int = 20, seconds: tuple[int, int] | None = None
) -> DataFrame:
    return resample_avg(readings, minutes, seconds).agg(F.count(F.lit(1)).alias("buckets"))


def max_level(readings: DataFrame) -> DataFrame:
    return readings.agg(F.max("liters").alias("max_liters"))


def max_level_per_equipment(readings: DataFrame) -> DataFrame:
    """A maximum needs no ``distinct`` before it: the partial aggregate does less work."""
    return readings.groupBy("eqmt").agg(F.max("liters").alias("max_liters"))


def distinct_levels(readings: DataFrame) -> DataFrame:
    return readings.select("liters", "eqmt").distinct().orderBy(F.desc("liters"), "eqmt")


def distinct_raw(readings: DataFrame) -> DataFrame:
    return readings.select("raw").distinct()


def distinct_equipment(readings: DataFrame) -> DataFrame:
    return readings.select("eqmt").distinct().orderBy("eqmt")


def day_span_of_levels(levels: DataFrame, time: str = "timecreated") -> DataFrame:
    """First and last day with a level, per machine."""
    day = F.to_date(time)
    return levels.groupBy("eqmt").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def day_span_of_readings(readings: DataFrame) -> DataFrame:
    """The same on raw readings, from each row's own time."""
    first, last = F.min("time_created"), F.max("time_created")
    return readings.groupBy("eqmt").agg(
        F.to_date(epoch_ms_to_ts(first)).alias("first_day"),
        F.to_date(epoch_ms_to_ts(last)).alias("last_day"),
    )


def time_span_of_levels(levels: DataFrame, time: str = "timecreated") -> DataFrame:
    return levels.agg(
        F.min(time).alias("first_time"), F.max(time).alias("last_time"),
        F.count(F.lit(1)).alias("row_count"),
    )


def reading_count(readings: DataFrame) -> DataFrame:
    return readings.agg(F.count(F.lit(1)).alias("row_count"))


def levels_between(
    levels: DataFrame,
    time_from: str,
    time_to: str,
    eqmt: str | int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Levels in an inclusive time range, in order."""
    at = F.col("timecreated")
    kept = levels.filter(
        at.between(F.lit(time_from).cast("timestamp"), F.lit(time_to).cast("timestamp"))
    )
    if eqmt is not None:
        kept = kept.filter(F.col("eqmt") == str(eqmt))
    kept = kept.orderBy("timecreated", "eqmt")
    return kept.limit(limit) if limit is not None else kept


def readings_between(
    readings: DataFrame,
    begin: int,
    end: int,
    eqmt: int | None = None,
    positive: bool = False,
) -> DataFrame:
    """Raw readings in an epoch-second range, optionally above zero only."""
    kept = readings.filter(epoch_second_range("time_created", begin, end))
    if eqmt is not None:
        kept = kept.filter(F.col("eqmt") == eqmt)
    return kept.filter(F.col("liters") > 0) if positive else kept


def shift_listing(
    shifts: DataFrame,
    date_from: str | None = None,
    date_of: str | None = None,
    date_to: str | None = None,
    descending: bool = False,
) -> DataFrame:
    """Shifts starting on or after a day, of a date, or up to a date."""
    if date_from is not None:
        shifts = shifts.filter(F.to_date("shiftstart") >= F.lit(date_from).cast("date"))
    if date_of is not None:
        shifts = shifts.filter(F.col("shiftdate") == F.lit(date_of).cast("date"))
    if date_to is not None:
        shifts = shifts.filter(F.col("shiftdate") <= F.lit(date_to).cast("date"))
    return shifts.orderBy(F.desc("shiftstart") if descending else F.asc("shiftstart"))
