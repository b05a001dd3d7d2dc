"""Fuel used from raw readings: as-of level difference and summed falls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import step
from .slots import merged_copies
from .spans import SPAN, answer, needed_readings, spans_of
from .sweeps import AFTER, UNIT_MS, both_ends, end_marks, exact, read_at


def level_as_of(readings: DataFrame, probes: DataFrame, slot_ms: int = UNIT_MS) -> DataFrame:
    """The last level at or before each ``probes(eqmt, at_ms)``: adds ``level``.

    No limit on how far back. The newest reading wins even when its level is
    NULL; of one millisecond's readings the highest level does.
    """
    marks = probes.select("eqmt", "at_ms").distinct().select("*", F.col("at_ms").alias("at"), F.lit(AFTER).alias("side"))
    rows = readings.select("eqmt", "time_created", "liters")
    return read_at(rows, marks, "liters", unit_ms=slot_ms).select("eqmt", "at_ms", F.col("before.value").alias("level"))


def fuel_level_difference(
    readings: DataFrame, intervals: DataFrame, slot_ms: int = UNIT_MS, prune: bool = True
) -> DataFrame:
    """Level as of the start minus level as of the end; may be negative.

    Readings and both moments of every request are sorted together, once. ``status`` is
    ``ok``, the bounds' own problem, or ``no_level``. An unknown start shift gives 0,
    as a call with one does; every other problem gives NULL.
    """
    usable = (F.col("bounds_status") == "ok") & F.col("eqmt").isNotNull()
    asked = intervals.filter(usable).select(*SPAN).distinct()
    if prune:
        # The later of both ends, since a request may be reversed.
        later = asked.select(
            "eqmt",
            F.least("from_ms", "to_ms").alias("from_ms"),
            F.greatest("from_ms", "to_ms").alias("to_ms"),
        )
        readings = needed_readings(readings, later, look_back=True)
    marks = end_marks(asked, "both").withColumn("side", F.lit(AFTER))
    read = read_at(readings.select("eqmt", "time_created", "liters"), marks, "liters", unit_ms=slot_ms)
    both = both_ends(read.select(*SPAN, "end", "before")).select(
        *SPAN,
        F.col("at_from.before.value").alias("start_level"),
        F.col("at_to.before.value").alias("end_level"),
    )
    known = {e: F.when(F.col("bounds_status") == "ok", F.col(e)) for e in ("start_level", "end_level")}
    found = answer(intervals, both).withColumns(known)
    difference = step(F.col("start_level"), F.col("end_level"))
    bounds = F.col("bounds_status")
    return found.withColumns(
        {
            "consumption": F.when(bounds == "start_missing", 0.0).when(bounds == "ok", difference),
            "status": F.when(bounds != "ok", bounds)
            .when(difference.isNull(), "no_level")
            .otherwise("ok"),
        }
    )


def _fall(before: Column, now: Column) -> dict[str, Column]:
    return {"fall": exact(F.greatest(step(before["value"], now["value"]), F.lit(0.0)))}


def fuel_used_raw_drops(
    readings: DataFrame,
    intervals: DataFrame,
    slot_ms: int = UNIT_MS,
    prune: bool = True,
) -> DataFrame:
    """Sum of the falls between neighboring raw readings inside the interval.

    Both ends included; NULL levels are skipped over; 0 when nothing fell and
    when there is no interval. The machine's running total of falls is read at both ends; the
    fall into the interval's first reading does not count.
    """
    known = readings.filter(F.col("liters").isNotNull())
    spans = spans_of(intervals)
    if prune:
        known = needed_readings(known, spans, look_back=False)
    read = read_at(merged_copies(known, "liters"), end_marks(spans, "both"), "liters", pairs=_fall, unit_ms=slot_ms)
    start, end = F.col("at_from"), F.col("at_to")
    into = F.coalesce(_fall(start["before"], start["after"])["fall"], F.lit(0))
    inside = start["after"]["at"] <= F.col("to_ms")
    used = both_ends(read).select(*SPAN, F.when(inside, (end["fall"] - start["fall"] - into).cast("double")).alias("fuel_used"))
    return answer(intervals, used).withColumn("fuel_used", F.coalesce("fuel_used", F.lit(0.0)))
