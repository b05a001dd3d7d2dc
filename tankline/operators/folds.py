"""States of ordered rows that compose: any stretch of time is put together from a few stored states.

Some questions cannot be answered by the difference of two totals (lowest level of a stretch, a state machine). For those, the
rows of a short unit of time are reduced to a state, and ``combine`` gives the state of two neighbouring stretches
``a`` and ``b`` from theirs. It must be associative. Units are composed to blocks of 16, 256 and 4,096 units, once for all
intervals. An interval is cut into whole blocks, at most thirty of each smaller size, and the cut units at its ends; raw
rows are read again only in those. So an interval takes a number of states that grows with the logarithm of its length.
The cut pieces are shared too: intervals that start or end at the same moment use the same.

No list holds more than the units of a block, or the pieces of an interval: both are bounded by time, whatever the
number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slots import in_order, merged_copies
from .spans import SPAN, needed_readings, unit_of
from .sweeps import UNIT_MS

#: Blocks that make one of the next size, and the number of sizes above a unit.
FAN, SIZES = 16, 3
PIECE = ("eqmt", "lo", "hi")


def composed(states: DataFrame, keys: tuple[str, ...], order: str, combine: str) -> DataFrame:
    """One ``state`` per key. ``combine`` is SQL over two neighbouring states, ``a`` before ``b``."""
    # SQL text, since an expression of this size takes long to build call by call.
    listed = states.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "state"))).alias("states"))
    rest = "transform(slice(states, 2, size(states)), s -> s.state)"
    return listed.select(*keys, F.expr(f"aggregate({rest}, states[0].state, (a, b) -> {combine})").alias("state"))


def with_blocks(states: DataFrame, unit_ms: int) -> DataFrame:
    """``eqmt, lo, hi, unit, state``: the state of each unit once for the unit itself and each block that holds it."""
    sizes = [unit_ms * FAN**k for k in range(SIZES + 1)]
    at = F.col("unit") * unit_ms
    blocks = [F.struct((at - F.pmod(at, F.lit(s))).alias("lo"), (at - F.pmod(at, F.lit(s)) + s).alias("hi")) for s in sizes]
    return states.select("eqmt", F.inline(F.array(*blocks)), "unit", "state")


def _numbers(first: Column, stop: Column) -> Column:
    return F.when(first < stop, F.sequence(first, stop - 1)).otherwise(F.array().cast("array<bigint>"))


def pieces_of(spans: DataFrame, closed: str, unit_ms: int) -> DataFrame:
    """Each span with the pieces ``lo, hi`` that it consists of; ``cut`` marks those that are no whole unit or block."""
    stop = F.col("to_ms") + (1 if closed == "both" else 0)
    lo = [unit_of(F.col("from_ms") + (unit_ms * FAN**k - 1), unit_ms * FAN**k) for k in range(SIZES + 1)]
    hi = [unit_of(stop, unit_ms * FAN**k) for k in range(SIZES + 1)]
    first, last = lo[0] * unit_ms, hi[0] * unit_ms

    def piece(a: Column, b: Column, cut: bool) -> Column:
        return F.struct(a.alias("lo"), b.alias("hi"), F.lit(cut).alias("cut"))

    def blocks(numbers: Column, k: int) -> Column:
        size = unit_ms * FAN**k
        return F.transform(numbers, lambda i: piece(i * size, (i + 1) * size, False))

    within = first > last
    found = [
        F.array(piece(F.col("from_ms"), F.when(within, stop).otherwise(first), True)),
        F.array(piece(last, F.when(within, last).otherwise(stop), True)),
    ]
    for k in range(SIZES + 1):
        # Whole blocks of this size; those inside one of the next size are left to it.
        if k == SIZES:
            found.append(blocks(_numbers(lo[k], hi[k]), k))
            continue
        inner = lo[k + 1] < hi[k + 1]
        found.append(blocks(_numbers(lo[k], F.when(inner, lo[k + 1] * FAN).otherwise(hi[k])), k))
        found.append(blocks(F.when(inner, _numbers(hi[k + 1] * FAN, hi[k])).otherwise(F.array().cast("array<bigint>")), k))
    pieces = F.filter(F.flatten(F.array(*found)), lambda p: p["lo"] < p["hi"])
    return spans.select("*", F.inline(pieces))


def states_in_spans(
    rows: DataFrame,
    spans: DataFrame,
    closed: str,
    summarize: Callable[[DataFrame, tuple[str, ...]], DataFrame],
    combine: str,
    value: str = "liters",
    unit_ms: int = UNIT_MS,
    prune: bool = True,
) -> DataFrame:
    """One row per span with rows: its ``state``.

    ``summarize(rows, keys)`` gets distinct rows with ``copies``, ``n``, ``prev`` and ``prev_time``, ordered within ``keys``,
    and returns one row per ``keys`` with ``state``. ``prune`` cuts the rows to the spans' time and machines at the scan.
    """
    if prune:
        rows = needed_readings(rows, spans, look_back=False)
    spans = spans.select(*SPAN).withColumn("eqmt", F.col("eqmt").cast(rows.schema["eqmt"].dataType))
    placed = merged_copies(rows, value).withColumn("unit", unit_of(F.col("time_created"), unit_ms))
    # Dealt out before they are joined, so that Spark knows how many there are when it decides how to join.
    pieces = pieces_of(spans, closed, unit_ms).repartition(*PIECE)
    units = summarize(in_order(placed, ("eqmt", "unit"), value), ("eqmt", "unit"))
    cut = pieces.filter("cut").select(*PIECE).distinct().withColumn("unit", unit_of(F.col("lo"), unit_ms))
    met = placed.join(cut, ["eqmt", "unit"]).filter((F.col("time_created") >= F.col("lo")) & (F.col("time_created") < F.col("hi")))
    ends = summarize(in_order(met, PIECE, value), PIECE)
    parts = with_blocks(units, unit_ms).unionByName(ends.select(*PIECE, F.lit(0).cast("long").alias("unit"), "state"))
    states = composed(parts, PIECE, "unit", combine)
    return composed(states.join(pieces.drop("cut"), list(PIECE)), SPAN, "lo", combine)
