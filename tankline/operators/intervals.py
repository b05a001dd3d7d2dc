"""From requests (machine, first shift, last shift) to time intervals.

``resolve_interval`` keeps every request and adds

* ``time_from, time_to``: zoneless wall-clock bounds,
* ``from_ms, to_ms``: the same as epoch milliseconds,
* ``bounds_status``: ``ok``, or why there is no interval.

One bad request does not stop a fleet; ``strict=True`` raises instead.

The calendar grows with time alone, two rows a day, and is joined on equality
keys: Spark broadcasts it while it is under the size threshold and shuffles it
beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wall_clock_ms

PLUS_12H = "plus_12h"
PLUS_12H_ROLLOVER = "plus_12h_rollover"
NEXT_OR_LAST_READING = "next_or_last_reading"
NEXT_OR_12H = "next_or_12h"
NEXT_ONLY = "next_only"
ONE_SHIFT = "one_shift"
NEXT_BY_NUMBER = "next_by_number"
END_SHIFT_START = "end_shift_start"
CALENDAR_DAYS = "calendar_days"
CALENDAR_DAYS_FULL = "calendar_days_full"

RULES = (
    PLUS_12H,
    PLUS_12H_ROLLOVER,
    NEXT_OR_LAST_READING,
    NEXT_OR_12H,
    NEXT_ONLY,
    ONE_SHIFT,
    NEXT_BY_NUMBER,
    END_SHIFT_START,
    CALENDAR_DAYS,
    CALENDAR_DAYS_FULL,
)

_ADDED = ("time_from", "time_to", "from_ms", "to_ms", "bounds_status")


def order_is_valid() -> Column:
    """Start not after end, by (date, shift). Unknown parts do not count as wrong."""
    wrong = (F.col("startdate") > F.col("enddate")) | (
        (F.col("startdate") == F.col("enddate")) & (F.col("startshift") > F.col("endshift"))
    )
    return ~F.coalesce(wrong, F.lit(False))


def validate_interval(requests: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``invalid``; with ``strict`` a wrong order fails the job when it runs."""
    checked = requests.withColumn("invalid", ~order_is_valid())
    if strict:
        message = "start must not be after end"
        checked = checked.withColumn(
            "invalid", F.when(F.col("invalid"), F.raise_error(F.lit(message)).cast("boolean"))
            .otherwise(F.lit(False))
        )
    return checked


def _calendar(shifts: DataFrame) -> DataFrame:
    """One row per (date, shift) with its start and the next shift's start."""
    # One ordered pass over the calendar, which grows with time only.
    order = Window.orderBy("shiftstart")
    return (
        shifts.select("shiftdate", "shift", "shiftstart")
        .withColumn("next_start", F.lead("shiftstart").over(order))
        .groupBy("shiftdate", "shift")
        .agg(
            F.min("shiftstart").alias("start"),
            F.min_by("next_start", "shiftstart").alias("next_start"),
        )
    )


def _next_by_number(requests: DataFrame, shifts: DataFrame) -> DataFrame:
    """For each (enddate, endshift) the start of the first later (date, shift).

    The end shift itself need not be in the calendar. Without one, the first shift
    of a later date counts.
    """
    marks = requests.select("enddate", "endshift").distinct().select(
        F.col("enddate").alias("d"),
        F.col("endshift").alias("s"),
        F.lit(None).cast("timestamp_ntz").alias("at"),
        F.lit(True).alias("mark"),
    )
    known = shifts.groupBy(F.col("shiftdate").alias("d"), F.col("shift").alias("s")).agg(
        F.min("shiftstart").alias("at"), F.lit(False).alias("mark")
    )
    # A mark sorts after the calendar row of the same (date, shift), one without a shift after its date.
    later = Window.orderBy("d", F.asc_nulls_last("s"), "mark").rowsBetween(1, Window.unboundedFollowing)
    return (
        known.unionByName(marks)
        .filter(F.col("d").isNotNull() & (F.col("s").isNotNull() | F.col("mark")))
        .withColumn("end_next", F.first("at", ignorenulls=True).over(later))
        .filter("mark")
        .select(F.col("d").alias("enddate"), F.col("s").alias("endshift"), "end_next")
    )


def _last_reading(readings: DataFrame) -> DataFrame:
    return readings.groupBy("eqmt").agg(F.max("time_created").alias("last_ms"))


def _from_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def resolve_interval(
    requests: DataFrame,
    shifts: DataFrame,
    rule: str,
    readings: DataFrame | None = None,
    validate: bool = False,
    tz: str | None = None,
    strict: bool = False,
    newest: DataFrame | None = None,
) -> DataFrame:
    """Resolve ``requests(eqmt, startdate, startshift, enddate, endshift)``.

    Every rule starts at the start shift's ``shiftstart``. The end is

    * ``plus_12h``: the end shift's start + 12 hours
    * ``plus_12h_rollover``: the same, a day later if not after the start
    * ``next_or_last_reading``: the next shift's start, else the machine's newest reading
    * ``next_or_12h``: the next shift's start, else the end shift's start + 12 hours
    * ``next_only``: the next shift's start
    * ``one_shift``: the shift after the *start* shift; the end shift is ignored
    * ``next_by_number``: first shift above (enddate, endshift), else the machine's
      newest reading at or after the start
    * ``end_shift_start``: the end shift's own start, else the next after the
      start, else start + 12 hours
    * ``calendar_days`` / ``calendar_days_full``: midnights of the two dates / of
      the first date and of the day after the second; shifts are ignored

    ``tz`` reads the calendar in that zone instead of the session's. ``newest(eqmt, last_ms)`` is the newest
    reading per machine where it is known (see ``sources.newest_readings``); otherwise ``readings`` are scanned for it.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    if rule in (NEXT_OR_LAST_READING, NEXT_BY_NUMBER) and readings is None and newest is None:
        raise ValueError(f"rule {rule!r} needs readings")
    asked = requests.columns
    start, end = F.col("start_at"), F.col("end_at")
    start_next, end_next = F.col("start_next"), F.col("end_next")
    half_day = F.expr("interval 12 hours")
    status = F.lit("ok")

    if rule in (CALENDAR_DAYS, CALENDAR_DAYS_FULL):
        extra = 1 if rule == CALENDAR_DAYS_FULL else 0
        df = requests.withColumns(
            {
                "time_from": F.col("startdate").cast("timestamp_ntz"),
                "time_to": F.date_add("enddate", extra).cast("timestamp_ntz"),
            }
        )
    else:
        calendar = _calendar(shifts)
        df = requests.join(
            calendar.select(
                F.col("shiftdate").alias("startdate"),
                F.col("shift").alias("startshift"),
                F.col("start").alias("start_at"),
                F.col("next_start").alias("start_next"),
            ),
            ["startdate", "startshift"],
            "left",
        )
        if rule == NEXT_BY_NUMBER:
            found = _next_by_number(requests, shifts).withColumnsRenamed({"enddate": "d__", "endshift": "s__"})
            same = (F.col("enddate") == F.col("d__")) & F.col("endshift").eqNullSafe(F.col("s__"))
            df = df.join(found, same, "left").drop("d__", "s__")
        elif rule != ONE_SHIFT:
            df = df.join(
                calendar.select(
                    F.col("shiftdate").alias("enddate"),
                    F.col("shift").alias("endshift"),
                    F.col("start").alias("end_at"),
                    F.col("next_start").alias("end_next"),
                ),
                ["enddate", "endshift"],
                "left",
            )
        time_to = {
            PLUS_12H: lambda: end + half_day,
            PLUS_12H_ROLLOVER: lambda: F.when(
                end + half_day <= start, end + half_day + F.expr("interval 1 day")
            ).otherwise(end + half_day),
            NEXT_OR_LAST_READING: lambda: end_next,
            NEXT_OR_12H: lambda: F.coalesce(end_next, end + half_day),
            NEXT_ONLY: lambda: end_next,
            ONE_SHIFT: lambda: start_next,
            NEXT_BY_NUMBER: lambda: end_next,
            END_SHIFT_START: lambda: F.coalesce(end, start_next, start + half_day),
        }[rule]()
        df = df.withColumns({"time_from": start, "time_to": time_to})

    df = df.withColumns(
        {
            "from_ms": wall_clock_ms(F.col("time_from"), tz),
            "to_ms": wall_clock_ms(F.col("time_to"), tz),
        }
    )
    if rule in (NEXT_OR_LAST_READING, NEXT_BY_NUMBER):
        df = df.join(_last_reading(readings) if newest is None else newest.select("eqmt", "last_ms"), "eqmt", "left")
        usable = F.col("last_ms")
        if rule == NEXT_BY_NUMBER:
            usable = F.when(usable >= F.col("from_ms"), usable)
        else:
            # The fallback serves a known end shift with no successor.
            usable = F.when(end.isNotNull(), usable)
        df = df.withColumns(
            {
                "to_ms": F.coalesce("to_ms", usable),
                "time_to": F.coalesce("time_to", _from_ms(usable)),
            }
        )
        if rule == NEXT_OR_LAST_READING:
            status = F.when(end.isNull(), "end_missing").when(
                F.col("to_ms").isNull(), "no_readings"
            ).otherwise("ok")
        else:
            status = F.when(F.col("to_ms").isNull(), "end_missing").otherwise("ok")
    else:
        status = F.when(F.col("time_to").isNull(), "end_missing").otherwise("ok")

    status = F.when(F.col("time_from").isNull(), "start_missing").otherwise(status)
    if validate:
        status = F.when(~order_is_valid(), "invalid_interval").otherwise(status)
    df = df.withColumn("bounds_status", status)
    if strict:
        failure = F.concat(F.lit("no interval: "), F.col("bounds_status"))
        df = df.withColumn(
            "bounds_status",
            F.when(F.col("bounds_status") == "ok", F.col("bounds_status")).otherwise(
                F.raise_error(failure).cast("string")
            ),
        )
    return df.select(*asked, *_ADDED)


def interval_of_seconds(requests: DataFrame) -> DataFrame:
    """The caller's own epoch seconds ``t0, t1``, both whole seconds included."""
    return requests.withColumns(
        {
            "from_ms": F.col("t0").cast("long") * 1000,
            "to_ms": F.col("t1").cast("long") * 1000 + 999,
            "time_from": _from_ms(F.col("t0").cast("long") * 1000),
            "time_to": _from_ms(F.col("t1").cast("long") * 1000),
            "bounds_status": F.when(F.col("t0").isNull(), "start_missing")
            .when(F.col("t1").isNull(), "end_missing")
            .otherwise("ok"),
        }
    )


def interval_of_times(requests: DataFrame, tz: str | None = None) -> DataFrame:
    """The caller's own zoneless ``time_from, time_to``."""
    return requests.withColumns(
        {
            "from_ms": wall_clock_ms(F.col("time_from"), tz),
            "to_ms": wall_clock_ms(F.col("time_to"), tz),
            "bounds_status": F.when(F.col("time_from").isNull(), "start_missing")
            .when(F.col("time_to").isNull(), "end_missing")
            .otherwise("ok"),
        }
    )
