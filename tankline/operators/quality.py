"""Fuel used with a data-quality status, over a range or by work shift."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import DAY_MS, share_percent, wall_clock_ms
from ..sources.calendar import wide_calendar
from .intervals import interval_of_seconds
from .limits import limit_of
from .resample import resampled
from .slots import SHARED, SLOT, edge_rows, end_units, is_whole
from .spans import SPAN, needed_readings, rows_in_spans, spans_of, unit_of


@dataclass(frozen=True)
class QualityLimits:
    max_fuel_diff: float = 70  # larger falls are jumps, liters per bucket
    min_fueling_level: float = 250  # rises from here on are refuels
    perc_no_data: float = 0.8  # share of unchanged levels: no data
    perc_need_cab: float = 0.1  # share of jumps: needs calibration


DEFAULT_LIMITS = QualityLimits()
# The preset of the parameterized queries.
LOOSE_LIMITS = QualityLimits(50, 10, 0.5, 0.3)


def _limit(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def _measures(limits: QualityLimits) -> list[Column]:
    fall = F.col("fuel_prev") - F.col("fuel")
    top = _limit(limits.max_fuel_diff)
    jump = (fall > top) | ((fall < -top) & (fall > -_limit(limits.min_fueling_level)))
    return [
        F.sum(F.when((fall > 0) & (fall < top), fall).otherwise(0.0)).alias("fuel_use"),
        F.sum(F.when(fall == 0, 1).otherwise(0)).alias("same"),
        F.sum(F.when(jump, 1).otherwise(0)).alias("jumps"),
        F.count(F.lit(1)).alias("points"),
    ]


def _verdict(limits: QualityLimits) -> list[Column]:
    flat = F.col("same") / F.col("points") > _limit(limits.perc_no_data)
    jumpy = F.col("jumps") / F.col("points") > _limit(limits.perc_need_cab)
    return [
        F.when(~(flat | jumpy), F.col("fuel_use")).alias("fuel_used"),
        F.when(flat, "no_data").when(jumpy, "need calibration").otherwise("Ok").alias("status"),
        F.when(~flat, share_percent(F.col("jumps"), F.col("points"))).alias("accuracy"),
    ]


def _positive_levels(levels: DataFrame) -> DataFrame:
    return levels.filter((F.col("fuel") > 0) & (F.col("fuel_prev") > 0))


def fuel_usage_quality(
    readings: DataFrame,
    begin: int,
    end: int,
    minutes: int = 20,
    limits: QualityLimits = DEFAULT_LIMITS,
    eqmt: int | None = None,
) -> DataFrame:
    """``eqmtid, fuel_used, status, accuracy`` per machine over an epoch-second range.

    ``fuel_used`` sums the falls below the limit and is NULL unless the status
    is ``Ok``. A fall or rise of exactly the limit counts nowhere. Machines with
    no usable level give no row.
    """
    if eqmt is not None:
        readings = readings.filter(F.col("eqmt") == eqmt)
    return (
        _positive_levels(resampled(readings, minutes, (begin, end)))
        .groupBy("eqmt")
        .agg(*_measures(limits))
        .select(F.col("eqmt").cast("string").alias("eqmtid"), *_verdict(limits))
    )


def _levels_of_spans(readings: DataFrame, spans: DataFrame, minutes: int, prune: bool) -> DataFrame:
    """The positive levels of each span's own buckets, with their previous one: ``eqmt, from_ms, to_ms, slot, fuel, fuel_prev``.

    A bucket that lies inside a span has one mean for all spans. Spans meet the buckets that hold readings day by day; only
    the two buckets at their ends are looked up one by one.
    """
    if 60 % minutes:
        raise ValueError("minutes must divide 60")
    slot_ms = minutes * 60_000
    if prune:
        readings = needed_readings(readings, spans, look_back=False)
    kind = readings.schema["eqmt"].dataType
    spans = spans.withColumn("eqmt", F.col("eqmt").cast(kind))
    placed = readings.withColumn("slot", unit_of(F.col("time_created"), slot_ms))
    mean = F.round(F.avg("liters"), 9).alias("fuel")
    shared = placed.groupBy(*SHARED).agg(mean)
    # minutes divide the hour, so a bucket lies within one day.
    inside = is_whole("both", slot_ms)
    whole = rows_in_spans(shared, spans, F.col("slot") * slot_ms, "both").filter(inside).select(*SLOT, "fuel")
    levels = whole.unionByName(edge_rows(placed, end_units(spans, "both", slot_ms), "both").groupBy(*SLOT).agg(mean))
    order = Window.partitionBy(*SPAN).orderBy("slot")
    return _positive_levels(levels.withColumn("fuel_prev", F.lag("fuel").over(order)))


def fuel_usage_quality_requests(
    readings: DataFrame,
    requests: DataFrame,
    minutes: int = 20,
    limits: QualityLimits = DEFAULT_LIMITS,
    prune: bool = True,
) -> DataFrame:
    """``fuel_used, status, accuracy`` of each request ``(eqmt, t0, t1)`` in epoch seconds.

    The range is cut before the previous level is taken, so the first bucket of each request
    has none. Requests may carry columns named as the fields of ``QualityLimits``;
    those replace ``limits`` row by row, where they are not NULL. Without a usable level the status is ``no_levels``.

    A bucket that lies inside a request has one mean for all requests; only the buckets at
    a request's ends are averaged for it alone. Buckets are cut in epoch time.
    """
    names = [f.name for f in fields(QualityLimits)]
    rowwise = {n: limit_of(requests, n, getattr(limits, n)) for n in names}
    intervals = interval_of_seconds(requests).withColumns(rowwise)
    levels = _levels_of_spans(readings, spans_of(intervals), minutes, prune)
    asked = intervals.select(*SPAN, *names).distinct()
    own = QualityLimits(*map(F.col, names))
    levels = levels.withColumn("eqmt", F.col("eqmt").cast(intervals.schema["eqmt"].dataType))
    found = levels.join(asked, list(SPAN)).groupBy(*SPAN, *names).agg(*_measures(own)).select(*SPAN, *names, *_verdict(own))
    kept = [c for c in intervals.columns if c not in ("time_from", "time_to", "from_ms", "to_ms", "bounds_status")]
    joined = intervals.join(found, [*SPAN, *names], "left")
    return joined.select(*kept, "fuel_used", F.coalesce("status", F.lit("no_levels")).alias("status"), "accuracy")


def _shift_days(shifts: DataFrame) -> DataFrame:
    """Every shift once for each day that it touches."""
    first = wall_clock_ms(F.col("shiftstart"))
    last = first + F.col("length").cast("long") * 1000
    return wide_calendar(shifts).select(
        first.alias("shift_ms"),
        last.alias("shift_end_ms"),
        "shiftstart_epoch",
        F.explode(F.sequence(unit_of(first, DAY_MS), unit_of(last, DAY_MS))).alias("day__"),
    )


def fuel_usage_quality_by_shift(
    readings: DataFrame,
    shifts: DataFrame,
    begin: int,
    end: int,
    minutes: int = 10,
    limits: QualityLimits = DEFAULT_LIMITS,
    eqmt: int | None = None,
) -> DataFrame:
    """The same per machine and shift: adds ``shiftstart_epoch``.

    The previous level is taken before the shifts are cut. A shift holds both
    its ends, so a bucket on the edge of two shifts counts in both; buckets in
    no shift form a group of their own with a NULL shift.
    """
    if eqmt is not None:
        readings = readings.filter(F.col("eqmt") == eqmt)
    by_day = _shift_days(shifts)
    levels = _positive_levels(resampled(readings, minutes, (begin, end)))
    at = F.unix_millis("tm")
    levels = levels.withColumn("tm_ms", at).withColumn("day__", unit_of(at, DAY_MS))
    in_shift = (levels["day__"] == by_day["day__"]) & levels["tm_ms"].between(
        by_day["shift_ms"], by_day["shift_end_ms"]
    )
    return (
        levels.join(by_day, in_shift, "left")
        .groupBy("eqmt", "shiftstart_epoch")
        .agg(*_measures(limits))
        .select(F.col("eqmt").alias("eqmtid"), "shiftstart_epoch", *_verdict(limits))
    )


def fuel_usage_quality_by_shift_requests(
    readings: DataFrame,
    requests: DataFrame,
    shifts: DataFrame,
    minutes: int = 10,
    limits: QualityLimits = DEFAULT_LIMITS,
    prune: bool = True,
) -> DataFrame:
    """``shiftstart_epoch, fuel_used, status, accuracy``: a row per request ``(eqmt, t0, t1)`` and shift with a usable level.

    As ``fuel_usage_quality_by_shift`` for a machine and range each: the range is cut first, then the previous level is
    taken, then the shifts are cut, edges counting on both sides. Limits per request as in ``fuel_usage_quality_requests``.
    """
    names = [f.name for f in fields(QualityLimits)]
    intervals = interval_of_seconds(requests).withColumns({n: limit_of(requests, n, getattr(limits, n)) for n in names})
    levels = _levels_of_spans(readings, spans_of(intervals), minutes, prune)
    levels = levels.withColumn("tm_ms", F.col("slot") * (minutes * 60_000))
    levels = levels.withColumns({"day__": unit_of(F.col("tm_ms"), DAY_MS), "eqmt": F.col("eqmt").cast(intervals.schema["eqmt"].dataType)})
    by_day = _shift_days(shifts)
    in_shift = (levels["day__"] == by_day["day__"]) & levels["tm_ms"].between(by_day["shift_ms"], by_day["shift_end_ms"])
    asked = intervals.select(*requests.columns, *[n for n in names if n not in requests.columns], "from_ms", "to_ms").distinct()
    keys = [*requests.columns, "shiftstart_epoch"]
    found = levels.join(by_day, in_shift, "left").join(asked, list(SPAN))
    grouped = found.groupBy(*dict.fromkeys([*keys, *names])).agg(*_measures(QualityLimits(*map(F.col, names))))
    return grouped.select(*keys, *_verdict(QualityLimits(*map(F.col, names))))
