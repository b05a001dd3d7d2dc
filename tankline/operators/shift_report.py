"""The shift report: fuel used and a status per machine and shift interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import DAY_MS, wall_clock_ms
from .drops import levels_for
from .limits import limit_of
from .resample import is_levels, levels_5min
from .spans import SPAN, spans_of, totals_in_spans, unit_of


def _share(limit: float | Column) -> Column:
    return limit if isinstance(limit, Column) else F.lit(limit)


def _report(perc_no_data: float | Column, perc_need_cab: float | Column) -> tuple[dict[str, Column], list[Column]]:
    """What to sum over an interval's levels, and what to say about the sums."""
    change = F.col("liters") - F.col("liters_prev")
    measures = {
        "fuel_used": F.when(change < 0, -change).otherwise(0),
        "rises": F.when(change > 0, 1).otherwise(0),
        "leaps": F.when(change > 15, 1).otherwise(0),
        "valid_points": F.lit(1),
    }
    # Shares compared without dividing: exact, and safe for any count.
    rising = F.col("rises") * 100 > F.col("valid_points") * _share(perc_no_data)
    leaping = F.col("leaps") * 100 > F.col("valid_points") * _share(perc_need_cab)
    verdict = [
        F.col("fuel_used").cast("decimal(28,3)").alias("fuel_used"),
        F.col("valid_points"),
        F.when(rising, "no_data")
        .when(leaping, "need calibration")
        .otherwise("ok")
        .alias("status"),
    ]
    return measures, verdict


def shift_fuel_report(
    readings: DataFrame,
    intervals: DataFrame,
    perc_no_data: float = 80,
    perc_need_cab: float = 30,
    prune: bool = True,
) -> DataFrame:
    """``eqmt_id, time_from, time_to, fuel_used, valid_points, status`` per request.

    Intervals are half-open. A level with no previous one counts as a point. The
    status does not blank ``fuel_used``. No readings, or no interval: no row. Requests may carry
    columns ``perc_no_data`` and ``perc_need_cab`` of their own; where one is NULL the argument counts.
    """
    perc_no_data, perc_need_cab = (
        limit_of(intervals, name, value) if name in intervals.columns else value
        for name, value in (("perc_no_data", perc_no_data), ("perc_need_cab", perc_need_cab))
    )
    measures, verdict = _report(perc_no_data, perc_need_cab)
    spans = spans_of(intervals)
    levels = levels_for(readings, spans, prune)
    sums = totals_in_spans(levels, spans, F.unix_millis("timecreated"), "left", measures)
    sums = sums.filter(F.col("valid_points") > 0).withColumn("eqmt", F.col("eqmt").cast("int"))
    return (
        intervals.filter(F.col("bounds_status") == "ok")
        .join(sums, list(SPAN))
        .select(F.col("eqmt").alias("eqmt_id"), "time_from", "time_to", *verdict)
    )


def shift_fuel_report_all(
    readings: DataFrame,
    shifts: DataFrame,
    perc_no_data: float = 80,
    perc_need_cab: float = 30,
) -> DataFrame:
    """The report for every machine and every shift that has a successor.

    Levels meet the calendar itself, so no list of machine-and-shift requests is
    built: each level lies in exactly one [shift start, next start).
    """
    measures, verdict = _report(perc_no_data, perc_need_cab)
    # One ordered pass over the calendar, which grows with time only.
    next_start = F.lead("shiftstart").over(Window.orderBy("shiftstart"))
    bounds = shifts.select(
        F.col("shiftstart").alias("time_from"), next_start.alias("time_to")
    ).filter(F.col("time_to").isNotNull())
    from_ms, to_ms = wall_clock_ms(F.col("time_from")), wall_clock_ms(F.col("time_to"))
    by_day = bounds.select(
        "time_from",
        "time_to",
        from_ms.alias("from_ms"),
        to_ms.alias("to_ms"),
        F.explode(F.sequence(unit_of(from_ms, DAY_MS), unit_of(to_ms - 1, DAY_MS))).alias("day__"),
    )
    at = F.unix_millis("timecreated")
    return (
        (readings if is_levels(readings) else levels_5min(readings))
        .filter(F.col("eqmt").isNotNull())
        .withColumn("at_ms", at)
        .withColumn("day__", unit_of(at, DAY_MS))
        .join(by_day, "day__")
        .filter((F.col("at_ms") >= F.col("from_ms")) & (F.col("at_ms") < F.col("to_ms")))
        .groupBy("eqmt", "time_from", "time_to")
        .agg(*[F.sum(m).alias(name) for name, m in measures.items()])
        .select(F.col("eqmt").cast("int").alias("eqmt_id"), "time_from", "time_to", *verdict)
    )
