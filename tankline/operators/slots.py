"""Raw rows in order, in pieces of bounded time.

Comparing each reading with the one before it needs an order, and one machine may own a third of all readings. So no
window over raw rows ever spans a machine: it runs inside a short unit of time.

Equal readings (same machine, millisecond and level) are first merged into one with a count. They are neighbors
in the order, so no difference between them exists, and a pile of copies shrinks before it is shuffled. Readings of one
millisecond are ordered by level, NULL first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import SPAN, is_inside, unit_of

#: Keys of a slot row of one interval, and of a slot row that all intervals share.
SLOT = (*SPAN, "slot")
SHARED = ("eqmt", "slot")


def merged_copies(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("eqmt", "time_created", value).agg(F.count(F.lit(1)).alias("copies"))


def in_order(rows: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Adds ``n`` (the position within ``keys``), ``prev`` and ``prev_time``, NULL on the first row."""
    order = Window.partitionBy(*keys).orderBy("time_created", F.asc_nulls_first(value))
    return rows.withColumns(
        {
            "n": F.row_number().over(order),
            "prev": F.lag(value).over(order),
            "prev_time": F.lag("time_created").over(order),
        }
    )


def is_whole(closed: str, slot_ms: int) -> Column:
    """Whether the slot lies inside the span."""
    begin = F.col("slot") * slot_ms
    last = F.col("to_ms") if closed == "both" else F.col("to_ms") - 1
    return (begin >= F.col("from_ms")) & (begin + (slot_ms - 1) <= last)


def end_units(spans: DataFrame, closed: str, slot_ms: int) -> DataFrame:
    """Each span with the slots of its two ends; ``whole`` where the slot lies inside it."""
    first, last = unit_of(F.col("from_ms"), slot_ms), unit_of(F.col("to_ms"), slot_ms)
    ends = spans.withColumn("slot", F.explode(F.array_distinct(F.array(first, last))))
    return ends.withColumn("whole", is_whole(closed, slot_ms))


def edge_rows(placed: DataFrame, units: DataFrame, closed: str) -> DataFrame:
    """The readings in slots that an end of a span cuts, as far as they lie inside it."""
    cut = units.filter(~F.col("whole")).drop("whole")
    # Dealt out first, so that Spark joins by their true size: cut spans may be far more than it expects.
    met = placed.join(cut.repartition(*SHARED), list(SHARED))
    return met.filter(is_inside(F.col("time_created"), closed))
