"""Resampled level series.

Readings shrink to one row per (machine, bucket) by a partial aggregate before
the first shuffle, so a machine or bucket with a huge share of the readings
costs no more than any other. The window that follows holds one machine's
buckets, a number bounded by the time span and not by the readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import epoch_ms_to_ts, epoch_second_range, fixed3, time_bucket


def range_filter(readings: DataFrame, begin: int, end: int) -> DataFrame:
    """Readings whose whole epoch second lies in [begin, end]."""
    return readings.filter(epoch_second_range("time_created", begin, end))


def resample_avg(
    readings: DataFrame, minutes: int, seconds: tuple[int, int] | None = None
) -> DataFrame:
    """Mean level per machine and bucket: ``tm, eqmt, fuel``. Empty buckets stay absent.

    The mean is kept to nine places: the order in which partial sums meet can
    then not change a later comparison.
    """
    if seconds is not None:
        readings = range_filter(readings, *seconds)
    mean = F.round(F.avg("liters"), 9).alias("fuel")
    if 15 % minutes == 0:
        # Every zone's offset is whole quarters of an hour, so these buckets are
        # plain epoch arithmetic: group by a number, make the time afterwards.
        at = F.col("time_created")
        start = at - F.pmod(at, F.lit(minutes * 60_000))
        means = readings.groupBy(start.alias("start"), "eqmt").agg(mean)
        return means.select(F.timestamp_millis("start").alias("tm"), "eqmt", "fuel")
    tm = time_bucket(epoch_ms_to_ts("time_created", exact=False), minutes)
    return readings.groupBy(tm.alias("tm"), "eqmt").agg(mean)


def with_previous(levels: DataFrame, value: str = "fuel", time: str = "tm") -> DataFrame:
    """Add ``<value>_prev``, the level of the machine's previous existing bucket."""
    order = Window.partitionBy("eqmt").orderBy(time)
    return levels.withColumn(f"{value}_prev", F.lag(value).over(order))


def resampled(
    readings: DataFrame, minutes: int, seconds: tuple[int, int] | None = None
) -> DataFrame:
    """``tm, eqmt, fuel, fuel_prev``. A range applies before the previous level is taken."""
    return with_previous(resample_avg(readings, minutes, seconds))


def levels_5min(readings: DataFrame) -> DataFrame:
    """The series most operators read: 5-minute levels over all history.

    ``timecreated, eqmt (text), liters, liters_prev``, levels as decimals with
    three places. No time range enters here: the first bucket of any later
    interval still has its previous level.
    """
    return resampled(readings, 5).select(
        F.col("tm").alias("timecreated"),
        F.col("eqmt").cast("string").alias("eqmt"),
        fixed3(F.col("fuel")).alias("liters"),
        fixed3(F.col("fuel_prev")).alias("liters_prev"),
    )


def is_levels(df: DataFrame) -> bool:
    """Whether a table holds levels (stored ones, say) rather than readings."""
    return {"timecreated", "liters_prev"} <= set(df.columns)


def levels_5min_ranged(
    readings: DataFrame, seconds: tuple[int, int] | None = None
) -> DataFrame:
    """``tm, eqmt (text), fuel, fuel_prev``, the range cut before the window."""
    return resampled(readings, 5, seconds).select(
        "tm",
        F.col("eqmt").cast("string").alias("eqmt"),
        fixed3(F.col("fuel")).alias("fuel"),
        fixed3(F.col("fuel_prev")).alias("fuel_prev"),
    )


def readings_with_bucket(readings: DataFrame, minutes: int = 5) -> DataFrame:
    """Every reading with its bucket and its own time as an instant."""
    return readings.select(
        time_bucket(epoch_ms_to_ts("time_created", exact=False), minutes).alias("time_created_5m"),
        epoch_ms_to_ts("time_created").alias("time_created_convert"),
        "time_created",
        "eqmt",
        "raw",
        "liters",
    )
