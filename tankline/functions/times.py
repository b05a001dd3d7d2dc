"""Time expressions. All return Columns; none needs a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def epoch_ms_to_ts(ms: Column | str, exact: bool = True) -> Column:
    """Epoch milliseconds to an instant, keeping or dropping the milliseconds."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    if exact:
        return F.timestamp_millis(ms)
    return F.timestamp_seconds(F.call_function("div", ms, F.lit(1000)))


def time_bucket(ts: Column | str, minutes: int) -> Column:
    """Start of the ``minutes`` bucket, counted from the top of the hour.

    When ``minutes`` does not divide 60 the last bucket of each hour is short.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    whole = F.call_function("div", F.minute(ts), F.lit(minutes)).cast("int") * minutes
    return F.date_trunc("hour", ts) + F.make_dt_interval(mins=whole)


def time_bucket_modulo(ts: Column | str, minutes: int = 10) -> Column:
    """The same bucket reached by going back ``minute % minutes`` from the minute."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc("minute", ts) - F.make_dt_interval(mins=F.minute(ts) % minutes)


def epoch_second_range(ms: Column | str, begin: int, end: int) -> Column:
    """``ms / 1000 BETWEEN begin AND end`` under integer division.

    Written as plain bounds on the stored milliseconds, so that the filter
    reaches the Parquet scan. Integer division truncates toward zero, hence the
    wider bound on the negative side.
    """
    ms = F.col(ms) if isinstance(ms, str) else ms
    low = begin * 1000 if begin > 0 else begin * 1000 - 999
    high = end * 1000 + 999 if end >= 0 else end * 1000
    return ms.between(low, high)


def wall_clock_ms(wall: Column, tz: str | None = None) -> Column:
    """Epoch ms of a zoneless timestamp read in ``tz`` (default: session zone)."""
    if tz is None:
        return F.unix_millis(wall.cast("timestamp"))
    utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), wall)
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), utc)
