"""Consumption between confirmed refills: a three-state machine, without a cursor.

The machine consumes, meets a possible refill (the level rises), confirms it
when the rises since the last fall reach a threshold at the second rise or
later, climbs to the peak, and starts a new stretch at the fall that follows.

Between two falls the level only rises, stays, or is unknown, so the falls cut
an interval into runs, and a run is confirmed when it has two rises or more and
their sum reaches the threshold. Each stretch between confirmed runs consumes
its first level minus its lowest. That needs counts and minima only:

1. inside a unit of time: change, run number, then one row per run;
2. the unit's state: the run open at its start, the first stretch that starts in it, the sum of
   those that start and end in it, and the run and stretch open at its end;
3. states of neighbours compose: the runs that meet are one run, or a fall lies between them. Composed states
   are stored in a tower (see ``folds``), so an interval takes few of them.

NULL levels: the changes on both sides are unknown, so they cut nothing. A level
after a NULL can lower a stretch only while no rise is pending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import step
from .folds import states_in_spans
from .spans import SPAN, answer, spans_of
from .sweeps import UNIT_MS


def _runs(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per (slot, run): rises, their sum, lowest calm level, level before the fall.

    A level is calm when the last change up to it, if any, was a fall: no rise of
    its run came before it.
    """
    so_far = (
        Window.partitionBy(*keys)
        .orderBy("time_created", F.asc_nulls_first("liters"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    change = F.col("change")
    risen = F.last(F.when(change != 0, change > 0), ignorenulls=True).over(so_far)
    marked = rows.withColumn("change", step(F.col("liters"), F.col("prev"))).withColumns(
        {
            "run": F.count_if(change < 0).over(so_far),
            "calm": ~F.coalesce(risen, F.lit(False)),
        }
    )
    return marked.groupBy(*keys, "run").agg(
        F.count_if(change > 0).alias("rises"),
        F.coalesce(F.sum(F.when(change > 0, change)), F.lit(0.0)).alias("climb"),
        F.min(F.when(F.col("calm"), F.col("liters"))).alias("low"),
        F.max(F.when(change < 0, F.col("prev"))).alias("peak"),
        F.min_by("liters", "n").alias("first"),
        F.max_by("liters", "n").alias("last"),
    )


def _states(runs: DataFrame, threshold: float, keys: tuple[str, ...]) -> DataFrame:
    """The state of the rows of each ``keys``, from their runs."""
    in_unit = Window.partitionBy(*keys).orderBy("run")
    # Run 0 continues what comes before; the stretches counted here start at run 1.
    ends = _is_confirmed(F.col("rises"), F.col("climb"), threshold) & (F.col("run") > 0)
    stretch = F.count_if(ends).over(in_unit.rowsBetween(Window.unboundedPreceding, -1))
    stretches = (
        runs.withColumn("stretch", F.coalesce(stretch, F.lit(0)))
        .groupBy(*keys, F.when(F.col("run") > 0, F.col("stretch")).otherwise(-1).alias("stretch"))
        .agg(
            F.min("low").alias("low"),
            F.min_by("peak", "run").alias("peak"),
            F.max_by("rises", "run").alias("rises"),
            F.max_by("climb", "run").alias("climb"),
            F.min_by("first", "run").alias("first"),
            F.max_by("last", "run").alias("last"),
        )
    )
    piece = F.struct("stretch", "peak", "low", "rises", "climb")
    head, tail = F.col("stretch") == 0, F.col("stretch") == F.col("newest")
    between = (F.col("stretch") > 0) & ~tail
    newest = F.max("stretch").over(Window.partitionBy(*keys))
    entry, first, last = F.col("entry"), F.col("head"), F.col("tail")
    parts = stretches.withColumn("newest", newest).groupBy(*keys).agg(
        F.min_by("first", "stretch").alias("first"),
        F.max_by("last", "stretch").alias("last"),
        F.max(F.when(F.col("stretch") == -1, piece)).alias("entry"),
        F.max(F.when(head, piece)).alias("head"),
        F.max(F.when((F.col("stretch") >= 0) & tail, piece)).alias("tail"),
        F.coalesce(F.sum(F.when(between, _positive(F.col("peak"), F.col("low")))), F.lit(0.0)).alias("closed"),
    )
    state = _state(
        first=F.col("first"),
        last=F.col("last"),
        low0=entry["low"],
        rises0=entry["rises"],
        climb0=entry["climb"],
        falls=first.isNotNull(),
        head_peak=first["peak"],
        head_low=first["low"],
        several=F.coalesce(last["stretch"] > 0, F.lit(False)),
        closed=F.col("closed"),
        peak=last["peak"],
        low=last["low"],
        rises=F.coalesce(last["rises"], entry["rises"]),
        climb=F.coalesce(last["climb"], entry["climb"]),
    )
    return parts.select(*keys, state.alias("state"))


#: First and last level; the run open at the start (lowest calm level, rises, climb); whether there is a fall; the first
#: stretch that starts here; whether it also ends here, and the sum of those that do so after it; the stretch and the
#: run open at the end.
_STATE = {
    "first": "double", "last": "double",
    "low0": "double", "rises0": "bigint", "climb0": "double",
    "falls": "boolean", "head_peak": "double", "head_low": "double",
    "several": "boolean", "closed": "double",
    "peak": "double", "low": "double", "rises": "bigint", "climb": "double",
}


def _state(**fields: Column) -> Column:
    return F.struct(*[fields[name].cast(kind).alias(name) for name, kind in _STATE.items()])


def _positive(a: Column, b: Column) -> Column:
    """a - b when positive; 0 otherwise and when either is unknown."""
    return F.when(a > b, a - b).otherwise(0.0)


def _is_confirmed(rises: Column, climb: Column, threshold: float) -> Column:
    return (rises >= 2) & (F.round(climb, 8) >= threshold)


def _combine(threshold: float) -> str:
    """The state of two neighbouring stretches of rows ``a`` and ``b`` from theirs, as SQL."""

    def state(s: str, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{name}', {fields.get(name, f'{s}.{name}')}" for name in _STATE) + ")"

    def positive(a: str, b: str) -> str:
        return f"CASE WHEN {a} > {b} THEN {a} - {b} ELSE 0D END"

    def fall(s: str, peak: str, low: str, rises: str, climb: str) -> str:
        """A fall from ``peak`` ends the open run, and the stretch if that run was confirmed; then a new run starts."""
        done = f"({s}.falls AND {s}.rises >= 2 AND round({s}.climb, 8) >= {float(threshold)}D)"
        starts = f"(NOT {s}.falls OR {done})"
        return state(
            s,
            falls="true",
            head_peak=f"CASE WHEN {s}.falls THEN {s}.head_peak ELSE {peak} END",
            head_low=f"CASE WHEN NOT {s}.falls THEN {low} WHEN NOT {s}.several AND NOT {done} THEN least({s}.head_low, {low}) ELSE {s}.head_low END",
            several=f"{s}.several OR {done}",
            closed=f"{s}.closed + CASE WHEN {done} AND {s}.several THEN {positive(f'{s}.peak', f'{s}.low')} ELSE 0D END",
            peak=f"CASE WHEN {starts} THEN {peak} ELSE {s}.peak END",
            low=f"CASE WHEN {starts} THEN {low} ELSE least({s}.low, {low}) END",
            rises=rises,
            climb=climb,
        )

    # No fall between: the run open at the start of ``b`` is the one open at the end of ``a``. Its levels count as
    # calm only while nothing has risen.
    calm = "CASE WHEN a.rises = 0 AND NOT coalesce(c > 0, false) THEN b.low0 END"
    rises = "a.rises + CASE WHEN c > 0 THEN 1 ELSE 0 END + b.rises0"
    climb = "a.climb + CASE WHEN c > 0 THEN c ELSE 0D END + b.climb0"
    go_on = state(
        "a",
        low0=f"CASE WHEN a.falls THEN a.low0 ELSE least(a.low0, {calm}) END",
        rises0=f"CASE WHEN a.falls THEN a.rises0 ELSE {rises} END",
        climb0=f"CASE WHEN a.falls THEN a.climb0 ELSE {climb} END",
        head_low=f"CASE WHEN a.falls AND NOT a.several THEN least(a.head_low, {calm}) ELSE a.head_low END",
        low=f"CASE WHEN a.falls THEN least(a.low, {calm}) ELSE a.low END",
        rises=rises,
        climb=climb,
    )
    apart = fall("a", "a.last", "b.low0", "b.rises0", "b.climb0")
    met = f"transform(array(round(b.first - a.last, 8)), c -> CASE WHEN c < 0 THEN {apart} ELSE {go_on} END)[0]"
    # The falls of ``b``: its first stretch goes on with the open one or starts, and may end.
    more = f"CASE WHEN x.several THEN {positive('x.peak', 'x.low')} ELSE 0D END"
    ended = state("x", several="true", closed=f"x.closed + {more} + b.closed", peak="b.peak", low="b.low")
    begun = fall("s", "b.head_peak", "b.head_low", "b.rises", "b.climb")
    falls = f"transform(array({begun}), x -> CASE WHEN b.several THEN {ended} ELSE x END)[0]"
    joined = f"transform(array({met}), s -> CASE WHEN b.falls THEN {falls} ELSE s END)"
    return f"transform({joined}, s -> {state('s', last='b.last')})[0]"


def _consumed(s: Column, threshold: float) -> Column:
    """What an interval with this state consumed: its first stretch starts at the first level."""
    ended = _is_confirmed(s["rises0"], s["climb0"], threshold)
    own = _positive(s["first"], s["low0"])
    start = F.when(ended, s["head_peak"]).otherwise(s["first"])
    low = F.when(ended, s["head_low"]).otherwise(F.least(s["low0"], s["head_low"]))
    later = F.when(s["several"], s["closed"] + _positive(s["peak"], s["low"])).otherwise(0.0)
    return F.when(s["falls"], F.when(ended, own).otherwise(0.0) + _positive(start, low) + later).otherwise(own)


def fuel_between_confirmed_refills(
    readings: DataFrame,
    intervals: DataFrame,
    confirm_threshold: float = 100,
    slot_ms: int = UNIT_MS,
    prune: bool = True,
) -> DataFrame:
    """``consumption`` per request over the half-open interval; 0 where there is none.

    Confirmation is tested on the second consecutive rise and later, so a refuel
    seen in a single step is never confirmed, whatever its size.
    """

    def summarize(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        return _states(_runs(rows, keys), confirm_threshold, keys)

    combine = _combine(confirm_threshold)
    states = states_in_spans(
        readings, spans_of(intervals), "left", summarize, combine, unit_ms=slot_ms, prune=prune
    )
    consumed = F.round(_consumed(F.col("state"), confirm_threshold), 8).alias("consumption")
    return answer(intervals, states.select(*SPAN, consumed)).withColumn(
        "consumption",
        F.when(F.col("bounds_status") == "invalid_interval", None).otherwise(
            F.coalesce("consumption", F.lit(0.0))
        ),
    )
