"""Engine hours of a machine over a range of epoch seconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import DAY_MS
from ..sources.files import engine_hour_entries
from .intervals import interval_of_seconds
from .folds import states_in_spans
from .spans import HOUR_MS, SPAN, answer, spans_of
from .sweeps import AFTER, UNIT_MS, totals_at

# The statuses that count as idle, breakdown and waiting.
IDLE_STATUSES = (1, 3)


def _idle_until(asked: DataFrame, idle: DataFrame, statuses: Sequence[int], moments: Sequence[str]) -> DataFrame:
    """``asked(eqmt, ...)`` with each of its ``moments`` (ms) replaced by the idle milliseconds up to it.

    An idle interval [c, d) has lasted t - c milliseconds at t while it is open, and d - c afterwards. So the sum over all of a
    machine is t times the number of open ones, less the sum of their starts, plus that of the ended ones' lengths:
    running totals over starts and ends, read once per moment. No moment meets an interval.
    """
    c, d = F.unix_millis("t0"), F.unix_millis("t1")
    side = F.array(*[F.struct(at.alias("at"), F.lit(n).alias("net")) for at, n in ((c, 1), (d, -1))])
    counted = F.col("status").isin(list(statuses)) & (c < d) & F.col("eqmt").isNotNull()
    ends = idle.filter(counted).select("eqmt", F.inline(side)).groupBy("eqmt", "at").agg(F.sum("net").alias("open"))
    ends = ends.withColumn("started", F.col("open").cast("decimal(19,0)") * F.col("at").cast("decimal(19,0)"))
    marks = asked.select("*", F.inline(F.array(*[F.struct(F.lit(m).alias("moment"), F.col(m).alias("at")) for m in moments])))
    read = totals_at(ends, marks.withColumn("side", F.lit(AFTER)), ["open", "started"], DAY_MS)
    lasted = F.col("asked_at") * F.col("open") - F.col("started").cast("decimal(38,0)")
    found = read.withColumn("asked_at", F.coalesce(*[F.when(F.col("moment") == m, F.col(m)) for m in moments]).cast("decimal(19,0)"))
    keys = [c for c in asked.columns if c not in moments]
    sums = [F.max(F.when(F.col("moment") == m, lasted)).cast("bigint").alias(m) for m in moments]
    return found.groupBy(*keys).agg(*sums)


def idle_seconds(
    windows: DataFrame, idle: DataFrame, statuses: Sequence[int] = IDLE_STATUSES
) -> DataFrame:
    """Seconds of each ``windows(eqmt, t0, t1)`` spent in the given statuses.

    ``windows`` is in epoch seconds, ``idle(eqmt, status, t0, t1)`` in instants.
    Every distinct window gives a row, 0 without idle time. Overlapping idle
    intervals count each.
    """
    asked = windows.select("eqmt", "t0", "t1").distinct().withColumns(
        {"a": F.col("t0").cast("long") * 1000, "b": F.col("t1").cast("long") * 1000}
    )
    spent = F.when(F.col("t0") < F.col("t1"), F.col("b") - F.col("a"))
    return _idle_until(asked, idle, statuses, ("a", "b")).select(
        "eqmt", "t0", "t1", (F.coalesce(spent, F.lit(0)) / 1000.0).alias("idle_seconds")
    )


def _valid_entries(
    entries: DataFrame, spans: DataFrame, slot_ms: int, prune: bool
) -> DataFrame:
    """Per span: number, extremes and times of the believable meter entries.

    An entry is believable when the meter rose, and by no more than the hours
    since the entry before plus one. The comparison stays in whole milliseconds.
    """

    def believable(value, before, at, at_before):
        gain = value - before
        return (gain > 0) & ((gain - 1).cast("long") * HOUR_MS <= at - at_before)

    good = believable(
        F.col("engrs"), F.col("prev"), F.col("time_created"), F.col("prev_time")
    )

    # Merged copies: only the first of them rose, so each row weighs one.
    def summarize(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        state = F.struct(
            F.count_if(good).alias("kept"),
            F.min(F.when(good, F.col("engrs"))).alias("low"),
            F.max(F.when(good, F.col("engrs"))).alias("high"),
            F.min(F.when(good, F.col("time_created"))).alias("first_at"),
            F.max(F.when(good, F.col("time_created"))).alias("last_at"),
            F.min_by("engrs", "n").alias("entry"),
            F.min("time_created").alias("at"),
            F.max_by("engrs", "n").alias("last_entry"),
            F.max("time_created").alias("last_time"),
        )
        return rows.groupBy(*keys).agg(state.alias("state"))

    # The first entry of ``b`` is believable or not by the last one of ``a``.
    gain = "(b.entry - a.last_entry)"
    met = f"({gain} > 0 AND CAST({gain} - 1 AS bigint) * {HOUR_MS} <= b.at - a.last_time)"
    entry, at = (f"CASE WHEN {met} THEN b.{c} END" for c in ("entry", "at"))
    combine = f"""named_struct('kept', a.kept + b.kept + CASE WHEN {met} THEN 1 ELSE 0 END,
        'low', least(a.low, b.low, {entry}), 'high', greatest(a.high, b.high, {entry}),
        'first_at', least(a.first_at, b.first_at, {at}), 'last_at', greatest(a.last_at, b.last_at, {at}),
        'entry', a.entry, 'at', a.at, 'last_entry', b.last_entry, 'last_time', b.last_time)"""
    entries = engine_hour_entries(entries)
    states = states_in_spans(entries, spans, "both", summarize, combine, "engrs", slot_ms, prune)
    return states.select(*SPAN, *[F.col("state")[c].alias(c) for c in ("kept", "low", "high", "first_at", "last_at")])


def engine_hours(
    entries: DataFrame,
    requests: DataFrame,
    idle: DataFrame | None = None,
    literal: bool = False,
    slot_ms: int = UNIT_MS,
    prune: bool = True,
) -> DataFrame:
    """``engine_hours`` per request ``(eqmt, t0, t1)`` in epoch seconds.

    With two believable meter entries or more: the meter's gain between them,
    plus the working time before the first and after the last, to one place.
    Otherwise the working time of the range. Working time is elapsed time less
    idle time. ``literal`` always takes the second way.
    """
    intervals = interval_of_seconds(requests)
    spans = spans_of(intervals)
    if literal:
        found = spans.withColumns(
            {c: F.lit(None).cast("bigint") for c in ("kept", "first_at", "last_at", "gain")}
        )
    else:
        valid = _valid_entries(entries, spans, slot_ms, prune)
        found = spans.join(valid, list(SPAN), "left").select(
            *SPAN, "kept", "first_at", "last_at", (F.col("high") - F.col("low")).alias("gain")
        )
    # Whole seconds, as milliseconds.
    whole = lambda ms: F.col(ms) - F.pmod(F.col(ms), F.lit(1000))
    found = found.withColumns(
        {"end_ms": whole("to_ms"), "first_at": whole("first_at"), "last_at": whole("last_at")}
    )
    parts = {
        "idle_all": ("from_ms", "end_ms"),
        "idle_head": ("from_ms", "first_at"),
        "idle_tail": ("last_at", "end_ms"),
    }
    if idle is None:
        found = found.withColumns({part: F.lit(0) for part in parts})
    else:
        moments = {f"idle_{c}": F.col(c) for c in ("from_ms", "end_ms", "first_at", "last_at")}
        found = _idle_until(found.withColumns(moments), idle, IDLE_STATUSES, tuple(moments))
        spent = {part: F.when(F.col(a) < F.col(b), F.col(f"idle_{b}") - F.col(f"idle_{a}")) for part, (a, b) in parts.items()}
        found = found.withColumns({part: F.coalesce(ms, F.lit(0)) for part, ms in spent.items()})
    metered_ms = (
        F.col("gain").cast("long") * HOUR_MS
        + (F.col("end_ms") - F.col("last_at") - F.col("idle_tail"))
        + (F.col("first_at") - F.col("from_ms") - F.col("idle_head"))
    )
    # One exact division, so that rounding sees true halves.
    in_hours = metered_ms.cast("decimal(20,0)") / F.lit(HOUR_MS).cast("decimal(7,0)")
    metered = F.round(in_hours, 1).cast("double")
    elapsed = (F.col("end_ms") - F.col("from_ms") - F.col("idle_all")) / F.lit(float(HOUR_MS))
    hours = found.select(
        *SPAN, "kept", F.when(F.col("kept") > 1, metered).otherwise(elapsed).alias("engine_hours")
    )
    # A range that ends before it starts holds no span: its elapsed time is negative.
    return answer(intervals, hours).select(
        *requests.columns,
        F.coalesce("kept", F.lit(0)).cast("int").alias("kept"),
        F.coalesce("engine_hours", (F.col("t1") - F.col("t0")) / 3600.0).alias("engine_hours"),
    )
