"""Number expressions that follow exact-decimal rounding (half away from zero)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed3(value: Column) -> Column:
    """A floating level as a decimal with three places.

    The value goes through nine places first, so that 10.0025 held as
    10.00249999999999 still rounds to 10.003.
    """
    return F.round(value.cast("decimal(24,9)"), 3).cast("decimal(18,3)")


def round_half_up(value: Column, places: int) -> Column:
    return F.round(value, places)


def share_percent(part: Column, whole: Column, places: int = 1) -> Column:
    """``100 * part / whole`` in exact decimals; ``whole`` must not be zero."""
    wide = "decimal(20,0)"
    return F.round((part * 100).cast(wide) / whole.cast(wide), places)


def step(current: Column, previous: Column) -> Column:
    """Change of a raw level, cleared of binary noise below 1e-8.

    50.1 - 10.1 is 40.0 here, as in decimal arithmetic, so strict thresholds hold.
    """
    return F.round(current - previous, 8)
