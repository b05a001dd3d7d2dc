"""Consumption, refuels and anomalies of one interval in a single record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import step
from .slots import merged_copies
from .spans import SPAN, answer, needed_readings, spans_of
from .sweeps import UNIT_MS, both_ends, end_marks, exact, read_at


def analyze_fuel(
    readings: DataFrame,
    intervals: DataFrame,
    refill_sensitivity: float = 40,
    anomaly_threshold: float = 100,
    slot_ms: int = UNIT_MS,
    prune: bool = True,
) -> DataFrame:
    """Eight measures per request over the half-open interval.

    A rise above ``refill_sensitivity`` is a refuel and closes a stretch of
    consumption, which counts first level minus last level even when negative;
    the stretch left open at the end counts only when positive. A fall above
    ``anomaly_threshold`` is an anomaly and still consumption. Smaller rises are
    ignored.

    The stretches telescope, so none is built. With ``top`` the level after the
    last refuel (or the first level), consumption is::

        first + refilled - top + max(top - last, 0)

    All of these are running totals of the machine, or the nearest reading or refuel, read at both ends.

    NULL levels count as points and hide the changes next to them. A NULL first
    level makes consumption NULL once a refuel comes, and 0 otherwise.
    """

    def changes(before: Column, now: Column) -> dict[str, Column]:
        change = step(now["value"], before["value"])
        refill = change > refill_sensitivity
        return {
            "refilled": F.when(refill, exact(change)),
            "refills": F.when(refill, 1),
            "anomalies": F.when(change < -anomaly_threshold, 1),
        }

    def refilled_to(before: Column, now: Column) -> Column:
        return F.when(changes(before, now)["refills"] == 1, now["value"])

    spans = spans_of(intervals)
    if prune:
        readings = needed_readings(readings, spans, look_back=False)
    read = read_at(
        merged_copies(readings, "liters"),
        end_marks(spans, "left"),
        "liters",
        own=lambda: {"points": F.col("copies")},
        pairs=changes,
        latest=refilled_to,
        unit_ms=slot_ms,
    )
    at_from, at_to = F.col("at_from"), F.col("at_to")
    # The change into the interval's first reading is not one of its own.
    into = changes(at_from["before"], at_from["after"])
    sums = {name: at_to[name] - at_from[name] - F.coalesce(into[name], F.lit(0)) for name in into}
    sums = both_ends(read).filter(at_from["after"]["at"] < F.col("to_ms")).select(
        *SPAN,
        (at_to["points"] - at_from["points"]).alias("points"),
        *[total.cast("double" if name == "refilled" else "bigint").alias(name) for name, total in sums.items()],
        at_to["latest"].alias("top"),
        at_from["after"]["value"].alias("start_level"),
        at_to["before"]["value"].alias("end_level"),
    )
    start, end, top = F.col("start_level"), F.col("end_level"), F.when(F.col("refills") > 0, F.col("top"))
    open_stretch = F.when(F.coalesce(top, start) > end, F.coalesce(top, start) - end).otherwise(0.0)
    consumed = F.when(F.col("refills") > 0, start + F.col("refilled") - top + open_stretch).otherwise(
        open_stretch
    )
    hours = (F.col("to_ms") - F.col("from_ms")) / F.lit(3_600_000.0)
    return (
        answer(intervals, sums.withColumn("consumed", F.round(consumed, 8)))
        .withColumn(
            "total_consumption_liters",
            F.when(F.col("points").isNull(), F.lit(0.0)).otherwise(F.col("consumed")),
        )
        .select(
            *intervals.columns,
            "total_consumption_liters",
            F.coalesce(F.round("refilled", 8), F.lit(0.0)).alias("total_refilled_liters"),
            F.coalesce("refills", F.lit(0)).cast("int").alias("refills_count"),
            F.coalesce("anomalies", F.lit(0)).cast("int").alias("anomalous_drops_count"),
            F.when(
                (hours > 0) & (F.col("total_consumption_liters") > 0),
                F.col("total_consumption_liters") / hours,
            )
            .otherwise(0.0)
            .alias("avg_consumption_lph"),
            start.alias("start_fuel_level"),
            end.alias("end_fuel_level"),
            F.coalesce("points", F.lit(0)).cast("bigint").alias("data_points_processed"),
        )
    )
