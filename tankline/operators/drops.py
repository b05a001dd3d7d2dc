"""Fuel used over an interval from the 5-minute levels.

All of these take resolved intervals (see ``intervals``) and answer every
request, also those without readings or without an interval. Where levels are
used, ``readings`` may also be stored levels (see ``sources``). ``prune`` cuts the
input to the requests' time and machines; turn it off when the requests cover the
whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time_bucket_modulo
from .limits import Below, answer_by_limit, limit_of, sums_below, usable_spans
from .resample import is_levels, levels_5min
from .slots import merged_copies
from .spans import (
    SPAN,
    answer,
    needed_levels,
    needed_readings,
    spans_of,
    totals_in_spans,
)
from .sweeps import both_ends, end_marks, read_at, totals_at


def levels_for(source: DataFrame, spans: DataFrame, prune: bool) -> DataFrame:
    """5-minute levels, made from readings or already stored."""
    if not is_levels(source):
        return levels_5min(needed_readings(source, spans, True) if prune else source)
    return needed_levels(source, spans) if prune else source


def _if_ok(value: Column) -> Column:
    """NULL where the bounds could not be resolved."""
    return F.when(F.col("bounds_status") == "ok", value)


def _liters(total: Column) -> Column:
    """To one place; 0 for an interval without rows, NULL for no interval."""
    return _if_ok(F.round(F.coalesce(total, F.lit(0)), 1).cast("decimal(28,1)"))


def fuel_used_drops(
    readings: DataFrame,
    intervals: DataFrame,
    max_drop: float | None = None,
    prune: bool = True,
) -> DataFrame:
    """Sum of the level's falls, optionally only those strictly below ``max_drop``.

    Both ends included; rounded to one place; 0 when nothing fell. Requests may carry a column ``max_drop`` of their own;
    where it is NULL the argument counts.
    """
    if "max_drop" in intervals.columns:
        return _drops_by_limit(readings, intervals, max_drop, prune)
    fall = F.col("liters_prev") - F.col("liters")
    counted = fall > 0
    if max_drop is not None:
        counted &= fall < max_drop
    spans = spans_of(intervals)
    used = totals_in_spans(
        levels_for(readings, spans, prune),
        spans,
        F.unix_millis("timecreated"),
        "both",
        {"fuel_used": F.when(counted, fall)},
    )
    return answer(intervals, used).withColumn("fuel_used", _liters(F.col("fuel_used")))


def _changes(levels: DataFrame) -> DataFrame:
    """Falls, rises and all known changes of levels, each with its size, and 1 to count it."""
    fall = F.col("liters_prev") - F.col("liters")
    kinds = F.array(
        F.struct(F.when(fall > 0, "fall").when(fall < 0, "rise").alias("kind"), F.abs(fall).alias("size")),
        F.struct(F.when(fall.isNotNull(), "any").alias("kind"), F.lit(0).cast("decimal(18,3)").alias("size")),
    )
    rows = levels.select("eqmt", F.unix_millis("timecreated").alias("at"), F.inline(kinds)).filter(F.col("kind").isNotNull())
    return rows.withColumns({"total": F.col("size").cast("decimal(28,3)"), "n": F.lit(1).cast("long")})


def _drops_by_limit(readings: DataFrame, intervals: DataFrame, max_drop: float | None, prune: bool) -> DataFrame:
    limits = {"max_drop": limit_of(intervals, "max_drop", max_drop)}
    spans = usable_spans(intervals, limits)
    falls = _changes(levels_for(readings, spans, prune)).filter(F.col("kind") == "fall")
    found = sums_below(falls, spans, "both", [Below("used", "fall", "max_drop")], ["total"])
    return answer_by_limit(intervals, found, limits).withColumn("fuel_used", _liters(F.col("used_total"))).drop("used_total")


def refuel_segments(
    readings: DataFrame,
    intervals: DataFrame,
    refuel_threshold: float = 150,
    max_step_drop: float = 200,
    prune: bool = True,
) -> DataFrame:
    """Consumption between refuels: ``eqmt, from_ms, to_ms, seg_no, seg_consumption``.

    A rise above ``refuel_threshold`` opens a segment. Segments are numbered and summed once per machine, by running totals over
    its levels. A request has the segments between the numbers at its two ends; the
    first and the last are cut out by difference.
    """
    fall = F.col("liters_prev") - F.col("liters")
    counted = (fall > 0) & (fall < max_step_drop)
    measures = {
        "rows": F.lit(1),
        "refuels": F.when(-fall > refuel_threshold, 1).otherwise(0),
        "falls": F.when(counted, 1).otherwise(0),
        "total": F.when(counted, fall).otherwise(0).cast("decimal(28,3)"),
    }
    spans = spans_of(intervals)
    levels = levels_for(readings, spans, prune)
    rows = levels.select(
        "eqmt", F.unix_millis("timecreated").alias("at"), *[m.alias(name) for name, m in measures.items()]
    )
    read = totals_at(rows, end_marks(spans, "both"), [*measures])
    ends = both_ends(read).withColumn("eqmt", F.col("eqmt").cast(rows.schema["eqmt"].dataType))
    start, end = F.col("at_from"), F.col("at_to")

    # The machine's own segments, with the totals up to their ends.
    so_far = (
        Window.partitionBy("eqmt")
        .orderBy("at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sums = ("rows", "falls", "total")
    running = rows.withColumns({name: F.sum(name).over(so_far) for name in measures})
    own = running.groupBy("eqmt", F.col("refuels").alias("segment")).agg(*[F.max(s).alias(f"{s}_end") for s in sums])
    in_turn = Window.partitionBy("eqmt").orderBy("segment")
    own = own.withColumns({f"{s}_start": F.lag(f"{s}_end", 1, 0).over(in_turn) for s in sums})

    cut = ends.withColumn("segment", F.explode(F.sequence(start["refuels"], end["refuels"])))
    found = cut.join(own, ["eqmt", "segment"], "left")

    def inside(name: str) -> Column:
        last = F.when(F.col("segment") == end["refuels"], end[name]).otherwise(F.col(f"{name}_end"))
        first = F.when(F.col("segment") == start["refuels"], start[name]).otherwise(F.col(f"{name}_start"))
        return last - first

    return found.filter(inside("rows") > 0).select(
        *SPAN,
        (F.col("segment") - start["refuels"]).alias("seg_no"),
        F.when(inside("falls") > 0, inside("total")).cast("decimal(28,3)").alias("seg_consumption"),
    )


def fuel_used_by_segment(
    readings: DataFrame,
    intervals: DataFrame,
    refuel_threshold: float = 150,
    max_step_drop: float = 200,
    prune: bool = True,
) -> DataFrame:
    """The segments' total, rounded to one place, with their number."""
    total = (
        refuel_segments(readings, intervals, refuel_threshold, max_step_drop, prune)
        .groupBy(*SPAN)
        .agg(
            F.sum("seg_consumption").alias("fuel_used"),
            F.count(F.lit(1)).alias("segments"),
        )
    )
    return answer(intervals, total).withColumns(
        {
            "fuel_used": _liters(F.col("fuel_used")),
            "segments": _if_ok(F.coalesce("segments", F.lit(0))),
        }
    )


def clean_drop_rise(
    readings: DataFrame,
    intervals: DataFrame,
    refuel_threshold: float = 150,
    max_step_drop: float = 200,
    cap_rises: bool = True,
    prune: bool = True,
) -> DataFrame:
    """Falls up to ``max_step_drop`` and rises above ``refuel_threshold``.

    ``cap_rises`` also bounds the rises by ``max_step_drop``. Gives
    ``total_used, total_refueled, valid_points, total_points``, zeros when empty. Requests may
    carry columns ``refuel_threshold`` and ``max_step_drop`` of their own; where one is NULL the argument counts.
    """
    if {"refuel_threshold", "max_step_drop"} & set(intervals.columns):
        return _drop_rise_by_limit(readings, intervals, refuel_threshold, max_step_drop, cap_rises, prune)
    fall = F.col("liters_prev") - F.col("liters")
    drop = (fall > 0) & (fall <= max_step_drop)
    rise = -fall > refuel_threshold
    if cap_rises:
        rise &= -fall <= max_step_drop
    spans = spans_of(intervals)
    sums = totals_in_spans(
        levels_for(readings, spans, prune),
        spans,
        F.unix_millis("timecreated"),
        "both",
        {
            "total_used": F.when(drop, fall),
            "total_refueled": F.when(rise, -fall),
            "valid_points": F.when(drop | rise, 1),
            "total_points": F.when(fall.isNotNull(), 1),
        },
    )
    return answer(intervals, sums).withColumns(
        {
            "total_used": _liters(F.col("total_used")),
            "total_refueled": _liters(F.col("total_refueled")),
            "valid_points": _if_ok(F.coalesce("valid_points", F.lit(0)).cast("int")),
            "total_points": _if_ok(F.coalesce("total_points", F.lit(0)).cast("int")),
        }
    )


def _drop_rise_by_limit(
    readings: DataFrame, intervals: DataFrame, refuel_threshold: float, max_step_drop: float, cap_rises: bool, prune: bool
) -> DataFrame:
    limits = {
        "refuel_threshold": limit_of(intervals, "refuel_threshold", refuel_threshold),
        "max_step_drop": limit_of(intervals, "max_step_drop", max_step_drop),
    }
    spans = usable_spans(intervals, limits)
    asked = [
        Below("drops", "fall", "max_step_drop", True),
        Below("rises", "rise", "max_step_drop" if cap_rises else None, True),
        Below("small", "rise", "refuel_threshold", True),
        Below("points", "any"),
    ]
    found = sums_below(_changes(levels_for(readings, spans, prune)), spans, "both", asked, ["total", "n"])
    # With the cap below the threshold no rise counts.
    rise = {m: F.greatest(F.col(f"rises_{m}") - F.col(f"small_{m}"), F.lit(0)) for m in ("total", "n")}
    sums = found.select(
        *SPAN,
        *limits,
        F.col("drops_total").alias("total_used"),
        rise["total"].alias("total_refueled"),
        (F.col("drops_n") + rise["n"]).alias("valid_points"),
        F.col("points_n").alias("total_points"),
    )
    return answer_by_limit(intervals, sums, limits).withColumns(
        {c: _liters(F.col(c)) for c in ("total_used", "total_refueled")}
        | {c: _if_ok(F.coalesce(c, F.lit(0)).cast("int")) for c in ("valid_points", "total_points")}
    )


def fuel_used_first_last(
    readings: DataFrame, intervals: DataFrame, prune: bool = True
) -> DataFrame:
    """First minus last 10-minute mean of the interval's own readings.

    May be negative; NULL without readings. The range is exact to the
    millisecond, so an edge bucket averages only the readings inside.

    Buckets have sums that all requests share. A request looks up the nearest bucket with readings at both its ends;
    where an end cuts a bucket, the sums up to there are taken off.
    """
    spans = spans_of(intervals)
    if prune:
        readings = needed_readings(readings, spans, look_back=False)
    total = (F.col("liters") * F.col("copies")).try_cast("decimal(38,12)")
    sums = {"rows": F.col("copies"), "known": F.when(total.isNotNull(), F.col("copies")), "total": total}
    bucket = lambda at: F.unix_millis(time_bucket_modulo(F.timestamp_millis(at), 10))
    marks = end_marks(spans, "both")
    read = read_at(merged_copies(readings, "liters"), marks, "liters", lambda: sums, unit=bucket, by_unit=True)
    start, end = F.col("at_from"), F.col("at_to")

    def part(of: Column, kind: str) -> Column:
        return F.struct(*[of[f"{kind}_{name}"].alias(name) for name in sums])

    rest, begun = part(start, "rest"), part(end, "unit")
    within = F.struct(*[(start[f"rest_{name}"] - end[f"rest_{name}"]).alias(name) for name in sums])
    one = start["unit"] == end["unit"]
    first = (
        F.when(one, within)
        .when(rest["rows"] > 0, rest)
        .when(start["later_unit"] < end["unit"], part(start, "later"))
        .when(start["later_unit"] == end["unit"], begun)
    )
    last = (
        F.when(one, within)
        .when(begun["rows"] > 0, begun)
        .when(end["earlier_unit"] > start["unit"], part(end, "earlier"))
        .when(end["earlier_unit"] == start["unit"], rest)
    )

    def mean(of: Column) -> Column:
        return F.when(of["known"] > 0, F.round(of["total"].cast("double") / of["known"], 9))

    used = both_ends(read).select(*SPAN, first.alias("first"), last.alias("last"))
    return answer(intervals, used.select(*SPAN, (mean(F.col("first")) - mean(F.col("last"))).alias("fuel_used")))
