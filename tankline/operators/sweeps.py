"""What a machine's ordered rows say at chosen moments, in one pass over rows and moments together.

A mark is a moment at which something is asked, such as an end of an interval. Marks are put among the rows they
ask about and everything is sorted once. No row meets an interval: an interval has two marks, whatever its
length and however many others overlap it, so the work is rows plus marks.

Neighbours need an order, and one machine may own a third of all rows. So time is cut into units, and two windows
follow each other: one over the rows and marks of a (machine, unit), which leaves one row per unit and the marks; one over
the units and marks of a machine, a number bounded by time and not by rows. What crosses a unit's edge is
the pair of the last row before it and the first one after.

Totals are whole numbers or decimals, so that the difference of two of them is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import SPAN, unit_of

UNIT_MS = 900_000

#: A row's side in the order; marks stand before (0) or after (2) the rows of their millisecond.
BEFORE, ROW, AFTER = 0, 1, 2

Measures = dict[str, Column]


def end_marks(spans: DataFrame, closed: str) -> DataFrame:
    """Two marks per span, ``end`` being ``from`` or ``to``; the rows between them are those inside the span."""
    if closed not in ("both", "left"):
        raise ValueError("closed must be 'both' or 'left'")

    def mark(end: str, ms: str, side: int) -> Column:
        return F.struct(F.lit(end).alias("end"), F.col(ms).alias("at"), F.lit(side).alias("side"))

    last = AFTER if closed == "both" else BEFORE
    return spans.select(*SPAN, F.inline(F.array(mark("from", "from_ms", BEFORE), mark("to", "to_ms", last))))


def exact(value: Column) -> Column:
    """A change of level as a decimal with the eight places that ``step`` keeps; NULL where it is not a number."""
    return value.try_cast("decimal(38,8)")


def _summed(measures: Measures, on: Column, over) -> Measures:
    return {name: F.sum(F.when(on, F.coalesce(m, F.lit(0)))).over(over) for name, m in measures.items()}


def read_at(
    rows: DataFrame,
    marks: DataFrame,
    value: str,
    own: Callable[[], Measures] = dict,
    pairs: Callable[[Column, Column], Measures] | None = None,
    latest: Callable[[Column, Column], Column] | None = None,
    unit_ms: int = UNIT_MS,
    unit: Callable[[Column], Column] | None = None,
    by_unit: bool = False,
) -> DataFrame:
    """Every mark with what the machine's ``rows(eqmt, time_created, <value>, ...)`` say there.

    Rows of one millisecond are ordered by value, NULL first. Adds

    * ``before``, ``after``: structs ``at, value`` of the nearest rows on both sides;
    * a running total up to the mark of each measure of ``own()``, over rows, and of ``pairs(previous, current)``, over
      neighbours, both given as structs ``at, value``;
    * ``latest``: the newest value of ``latest(previous, current)`` that is not NULL, up to the mark.

    ``unit`` gives the number of the unit of an epoch time. With ``by_unit``, the mark also gets ``unit``, the totals
    ``unit_<measure>`` of the whole unit up to the mark and ``rest_<measure>`` after it, and the nearest other units
    with rows: ``earlier_<measure>``, ``later_<measure>``, ``earlier_unit`` and ``later_unit``. That is for ``own`` measures only.
    """
    unit = unit or (lambda at: unit_of(at, unit_ms))
    kind = rows.schema["eqmt"].dataType
    names = [c for c in marks.columns if c not in ("at", "side")]
    asked = marks.select(F.col("eqmt").cast(kind).alias("eqmt"), "at", "side", F.struct(*names).alias("mark"))
    mine = rows.withColumnRenamed("time_created", "at").withColumn("side", F.lit(ROW))
    df = mine.unionByName(asked, allowMissingColumns=True).withColumn("unit", unit(F.col("at")))

    in_unit = Window.partitionBy("eqmt", "unit").orderBy("at", "side", F.asc_nulls_first(value))
    backwards = Window.partitionBy("eqmt", "unit").orderBy(F.desc("at"), F.desc("side"), F.desc_nulls_last(value))
    past, so_far = in_unit.rowsBetween(Window.unboundedPreceding, -1), in_unit.rowsBetween(Window.unboundedPreceding, 0)
    is_row = F.col("side") == ROW
    here = F.when(is_row, F.struct("at", F.col(value).alias("value")))
    df = df.withColumns({"here": here})
    df = df.withColumns({"prev": F.last("here", True).over(past), "first": F.first("here", True).over(so_far)})
    df = df.withColumn("next", F.last("here", True).over(backwards.rowsBetween(Window.unboundedPreceding, -1)))
    has_pair = is_row & F.col("prev").isNotNull()
    measured = _summed(own(), is_row, so_far)
    crossing = pairs(F.col("prev"), F.col("here")) if pairs else {}
    measured |= _summed(crossing, has_pair, so_far)
    kept = F.last(F.when(has_pair, latest(F.col("prev"), F.col("here"))), True).over(so_far) if latest else None
    if kept is not None:
        measured["latest"] = kept
    if by_unit:
        whole = Window.partitionBy("eqmt", "unit")
        measured |= {f"rest_{name}": F.sum(F.when(is_row, F.coalesce(m, F.lit(0)))).over(whole) for name, m in own().items()}
    df = df.withColumns(measured)
    # One row per unit, with its sums, and the marks.
    df = df.filter(~is_row | F.col("next").isNull())

    earlier = Window.partitionBy("eqmt").orderBy("unit").rangeBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("eqmt").orderBy(F.desc("unit")).rangeBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("left", F.last("here", True).over(earlier))
    totals = [*own(), *crossing]
    crossed = pairs(F.col("left"), F.col("first")) if pairs else {}
    met = F.col("left").isNotNull() & F.col("first").isNotNull()
    df = df.withColumns({name: F.coalesce(F.col(name), F.lit(0)) + F.when(met, F.coalesce(crossed.get(name, F.lit(0)), F.lit(0))).otherwise(F.lit(0)) for name in totals})
    if latest:
        df = df.withColumn("latest", F.coalesce("latest", F.when(met, latest(F.col("left"), F.col("first")))))
    found = {
        "before": F.coalesce("prev", "left"),
        "after": F.coalesce(F.col("next"), F.last(F.when(is_row, F.col("first")), True).over(later)),
    }
    found |= {name: F.col(name) + F.coalesce(F.sum(F.when(is_row, F.col(name))).over(earlier), F.lit(0)) for name in totals}
    if latest:
        found["latest"] = F.coalesce(F.col("latest"), F.last(F.when(is_row, F.col("latest")), True).over(earlier))
    if by_unit:
        sums = F.when(is_row, F.struct("unit", *own()))
        for side, window in (("earlier", earlier), ("later", later)):
            nearest = F.last(sums, True).over(window)
            found |= {f"{side}_unit": nearest["unit"]} | {f"{side}_{name}": nearest[name] for name in own()}
        found |= {f"unit_{name}": F.col(name) for name in own()}
        found |= {f"rest_{name}": F.coalesce(F.col(f"rest_{name}"), F.lit(0)) - F.col(name) for name in own()}
    columns = [F.col("mark")[n].alias(n) for n in names]
    extra = ["unit"] if by_unit else []
    return df.withColumns(found).filter(~is_row).select(*columns, *extra, *found)


def totals_at(rows: DataFrame, marks: DataFrame, measures: list[str], unit_ms: int | None = None) -> DataFrame:
    """Every mark with the running totals up to it of the columns ``measures`` of ``rows(eqmt, at, ...)``.

    Without ``unit_ms`` the rows must be few per machine, such as levels: one window sums them. With it they are summed by unit
    of time first, so that no window holds more than the rows of a unit, or the units of a machine.
    """
    kind = rows.schema["eqmt"].dataType
    names = [c for c in marks.columns if c not in ("at", "side")]
    asked = marks.select(F.col("eqmt").cast(kind).alias("eqmt"), "at", "side", F.struct(*names).alias("mark"))
    df = rows.select("eqmt", "at", F.lit(ROW).alias("side"), *measures).unionByName(asked, allowMissingColumns=True)
    keys = ["eqmt"]
    if unit_ms:
        df, keys = df.withColumn("unit", unit_of(F.col("at"), unit_ms)), ["eqmt", "unit"]
    so_far = Window.partitionBy(*keys).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    totals = {m: F.coalesce(F.sum(m).over(so_far), F.lit(0)) for m in measures}
    columns = [F.col("mark")[n].alias(n) for n in names]
    if not unit_ms:
        return df.withColumns(totals).filter(F.col("side") != ROW).select(*columns, *measures)
    last = F.lead("side").over(Window.partitionBy(*keys).orderBy("at", "side"))
    # A unit's newest row, be it a mark, has its sums; only rows that are marks or the newest stay.
    df = df.withColumns(totals | {"newest": last.isNull()}).filter((F.col("side") != ROW) | F.col("newest"))
    earlier = Window.partitionBy("eqmt").orderBy("unit").rangeBetween(Window.unboundedPreceding, -1)
    sums = {m: F.col(m) + F.coalesce(F.sum(F.when(F.col("newest"), F.col(m))).over(earlier), F.lit(0)) for m in measures}
    return df.withColumns(sums).filter(F.col("side") != ROW).select(*columns, *measures)


def both_ends(read: DataFrame) -> DataFrame:
    """One row per span: what was read at its ends, as structs ``at_from`` and ``at_to``."""
    fields = F.struct(*[c for c in read.columns if c not in (*SPAN, "end")])
    return read.groupBy(*SPAN).agg(*[F.max(F.when(F.col("end") == end, fields)).alias(f"at_{end}") for end in ("from", "to")])
