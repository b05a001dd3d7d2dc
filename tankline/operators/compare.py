"""Several definitions of fuel used, side by side for the same requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals as rules
from .confirmed_refills import fuel_between_confirmed_refills
from .raw_levels import fuel_level_difference, fuel_used_raw_drops
from .refuels import analyze_fuel


def compare_methods(
    readings: DataFrame, shifts: DataFrame, requests: DataFrame, prune: bool = True
) -> DataFrame:
    """One row per distinct request with a column per method; NULL fields are values like others.

    Each method keeps its own rule for the interval.
    """
    asked = requests.distinct()
    keys = asked.columns

    def resolved(rule: str, **more) -> DataFrame:
        return rules.resolve_interval(asked, shifts, rule, readings=readings, **more)

    parts = [
        fuel_level_difference(readings, resolved(rules.NEXT_BY_NUMBER, tz="UTC"), prune=prune).select(
            *keys, F.col("consumption").alias("level_difference")
        ),
        fuel_used_raw_drops(readings, resolved(rules.NEXT_ONLY), prune=prune).select(
            *keys, F.col("fuel_used").alias("raw_drops")
        ),
        analyze_fuel(readings, resolved(rules.NEXT_OR_12H), prune=prune).select(
            *keys, F.col("total_consumption_liters").alias("refuel_stretches")
        ),
        fuel_between_confirmed_refills(
            readings, resolved(rules.NEXT_OR_LAST_READING, validate=True), prune=prune
        ).select(*keys, F.col("consumption").alias("confirmed_refills")),
    ]
    joined = asked
    for part in parts:
        named = part.select(*[F.col(k).alias(f"{k}__") for k in keys], part.columns[-1])
        alike = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]
        joined = joined.join(named, alike, "left").drop(*[f"{k}__" for k in keys])
    return joined
