"""Bringing a time series and many intervals together, without a nested loop.

``totals_in_spans`` is for sums and counts: one running total per machine, read
at the two ends of every interval. Its work is the series plus the intervals,
however much the intervals overlap.

``rows_in_spans`` gives the rows of each interval themselves. The interval is cut
into the days it touches and joined on (machine, day), then the exact bounds are
applied. An interval has each day once, so no match comes twice. The cut intervals
may be many times larger than Spark expects of the uncut ones, so they are dealt out
first and joined by their true size; a hot (machine, day) is split by Spark's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import DAY_MS

SPAN = ("eqmt", "from_ms", "to_ms")

HOUR_MS = 3_600_000


def unit_of(ms: Column, unit_ms: int) -> Column:
    """Number of the unit (day, hour) of an epoch time, also before 1970."""
    return F.call_function("div", ms - F.pmod(ms, F.lit(unit_ms)), F.lit(unit_ms))


def units_in(spans: DataFrame, unit_ms: int, name: str) -> DataFrame:
    """Each span once for every unit it touches."""
    first, last = unit_of(F.col("from_ms"), unit_ms), unit_of(F.col("to_ms"), unit_ms)
    return spans.withColumn(name, F.explode(F.sequence(first, last)))


def is_inside(at: Column, closed: str) -> Column:
    if closed not in ("both", "left"):
        raise ValueError("closed must be 'both' or 'left'")
    before_end = at <= F.col("to_ms") if closed == "both" else at < F.col("to_ms")
    return (at >= F.col("from_ms")) & before_end


def spans_of(intervals: DataFrame) -> DataFrame:
    """The distinct usable (machine, from, to) of resolved requests."""
    usable = (F.col("bounds_status") == "ok") & (F.col("from_ms") <= F.col("to_ms"))
    return intervals.filter(usable & F.col("eqmt").isNotNull()).select(*SPAN).distinct()


def _bound(spans: DataFrame, name: str, largest: bool, as_time: bool = False) -> Column:
    """Least or largest value of a span column, as a scalar subquery; milliseconds as a time if asked for."""
    # Sort-and-take instead of min and max: Spark merges several aggregates into
    # one struct, whose fields it does not hand to the Parquet reader.
    order = F.desc(name) if largest else F.asc(name)
    value = F.timestamp_millis(name).alias(name) if as_time else F.col(name)
    return spans.select(value).orderBy(order).limit(1).scalar()


def needed_levels(levels: DataFrame, spans: DataFrame) -> DataFrame:
    """Levels within the time of all spans: each carries its previous level.

    The stored time itself is compared, so that the bounds reach Parquet.
    """
    at = F.col("timecreated")
    first, last = _bound(spans, "from_ms", False, True), _bound(spans, "to_ms", True, True)
    return levels.filter((at >= first) & (at <= last))


def needed_readings(readings: DataFrame, spans: DataFrame, look_back: bool) -> DataFrame:
    """Drop readings that no span can use, at the scan and without a join.

    The bounds of time and machine are scalar subqueries: they run first and
    reach the Parquet reader as literals. With ``look_back`` older readings
    stay, since a previous bucket may be arbitrarily old.
    """
    at, eqmt = F.col("time_created"), F.col("eqmt")
    # A level counts the whole bucket that starts inside a span.
    margin = HOUR_MS if look_back else 0
    wanted = at <= _bound(spans, "to_ms", True) + margin
    if not look_back:
        wanted &= at >= _bound(spans, "from_ms", False)
    return readings.filter(
        wanted & (eqmt >= _bound(spans, "eqmt", False)) & (eqmt <= _bound(spans, "eqmt", True))
    )


def rows_in_spans(rows: DataFrame, spans: DataFrame, at_ms: Column, closed: str) -> DataFrame:
    """Inner join of ``rows`` to the spans that hold them.

    ``closed`` is ``both`` or ``left``. The result has the rows' own columns and
    ``from_ms, to_ms``; a row in several spans appears once in each.
    """
    kind = rows.schema["eqmt"].dataType
    days = units_in(spans.withColumn("eqmt", F.col("eqmt").cast(kind)), DAY_MS, "day__")
    return (
        rows.withColumn("at__", at_ms)
        .withColumn("day__", unit_of(F.col("at__"), DAY_MS))
        .join(days.repartition("eqmt", "day__"), ["eqmt", "day__"])
        .filter(is_inside(F.col("at__"), closed))
        .drop("at__", "day__")
    )


def totals_in_spans(
    rows: DataFrame,
    spans: DataFrame,
    at_ms: Column,
    closed: str,
    measures: dict[str, Column],
) -> DataFrame:
    """Sums of ``measures`` over the rows of each span; spans without rows get zeros.

    ``rows`` must be few per machine (levels, slots): a machine's rows and the
    distinct ends of its spans are summed in one ordered pass. Measures must be
    whole numbers or decimals, so that the difference of two totals is exact.
    """
    kind = rows.schema["eqmt"].dataType
    # Ends before the rows of their millisecond exclude them, ends after include.
    first, last = 0, 2 if closed == "both" else 0

    def end(ms: str, side: int, sign: int) -> Column:
        return F.struct(
            F.col(ms).alias("at__"), F.lit(side).alias("side__"), F.lit(sign).alias("sign__")
        )

    ends = F.inline(F.array(end("from_ms", first, -1), end("to_ms", last, 1)))
    asked = spans.select(F.col("eqmt").cast(kind).alias("eqmt"), "from_ms", "to_ms", ends)
    valued = rows.select(
        "eqmt",
        at_ms.alias("at__"),
        F.lit(1).alias("side__"),
        *[F.coalesce(m, F.lit(0)).alias(name) for name, m in measures.items()],
    )
    marks = asked.select("eqmt", "at__", "side__").distinct()
    running = (
        Window.partitionBy("eqmt")
        .orderBy("at__", "side__")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = (
        valued.unionByName(marks, allowMissingColumns=True)
        .withColumns({name: F.sum(name).over(running) for name in measures})
        .filter(F.col("side__") != 1)
    )

    def difference(name: str) -> Column:
        total = F.coalesce(F.col(name), F.lit(0))
        return F.sum(F.when(F.col("sign__") > 0, total).otherwise(-total)).alias(name)

    return (
        asked.join(totals, ["eqmt", "at__", "side__"])
        .groupBy(*SPAN)
        .agg(*[difference(name) for name in measures])
    )


def answer(intervals: DataFrame, per_span: DataFrame) -> DataFrame:
    """Give every request the result of its span; requests without one get NULLs."""
    kind = intervals.schema["eqmt"].dataType
    found = per_span.withColumn("eqmt", F.col("eqmt").cast(kind))
    return intervals.join(found, list(SPAN), "left")
