"""Listings of levels, one row per bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resample import levels_5min_ranged

DELTA = "delta"
FALL = "fall"
CHANGE = "change"


def level_trace(
    levels: DataFrame,
    form: str = DELTA,
    eqmt: str | int | None = None,
    time_from: str | None = None,
    time_to: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Levels with their change, in time order.

    ``delta``: level minus previous to one place. ``fall``: previous minus level
    to three places. ``change``: level minus previous unrounded, with the fall
    as ``fuel_used``. Time bounds are included. ``limit`` keeps the first rows.
    """
    if eqmt is not None:
        levels = levels.filter(F.col("eqmt") == str(eqmt))
    if time_from is not None:
        levels = levels.filter(F.col("timecreated") >= F.lit(time_from).cast("timestamp"))
    if time_to is not None:
        levels = levels.filter(F.col("timecreated") <= F.lit(time_to).cast("timestamp"))
    change = F.col("liters") - F.col("liters_prev")
    columns = {
        DELTA: [F.round(change, 1).alias("delta")],
        FALL: [F.round(-change, 3).alias("delta")],
        CHANGE: [
            change.alias("diff"),
            F.when(change < 0, -change).otherwise(0).cast("decimal(19,3)").alias("fuel_used"),
        ],
    }
    listed = levels.select("eqmt", "timecreated", "liters", "liters_prev", *columns[form])
    listed = listed.orderBy("timecreated", "eqmt")
    return listed.limit(limit) if limit is not None else listed


def level_trace_ranged(
    readings: DataFrame, begin: int, end: int, eqmt: int | None = None
) -> DataFrame:
    """5-minute trace of an epoch-second range, of one machine or all, by (machine, time)."""
    if eqmt is not None:
        readings = readings.filter(F.col("eqmt") == eqmt)
    return levels_5min_ranged(readings, (begin, end)).orderBy("eqmt", "tm")
