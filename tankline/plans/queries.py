"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as ops
from ..functions import epoch_ms_to_ts, time_bucket, time_bucket_modulo
from ..operators import intervals as rules
from ..operators import profile, traces
from .. import sources
from ..sources import (
    calendar_of,
    materialize_levels,
    read_level_csv,
    read_levels,
    read_readings,
    write_level_csv,
)
from . import tables as t
from .tables import MONTH, TEN_DAYS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Bounds of the queries that take a range.
FROM_TIME, TO_TIME = "2024-01-05 08:45:00", "2024-01-25 20:45:00"


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # The given tables hold zoneless times, read as UTC by both engines. A session
        # in another zone is left alone.
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark = spark.newSession()
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        return t.plain(fn(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


# Sources and sinks


@query
def read_readings_mapped(spark, sf_dir):
    mapped = read_readings(
        spark,
        f"{sf_dir}/events.parquet",
        {"time_created": "event_id", "eqmt": "user_id", "raw": "props", "liters": "value"},
    )
    return mapped


@query
def readings_of_events(spark, sf_dir):
    return t.readings(spark, sf_dir)


def stored(spark, df):
    """Writes a derived table to the shared folder; returns its path."""
    path = t.run_folder(spark)
    df.write.parquet(path)
    return path


@query
def read_shifts(spark, sf_dir):
    return sources.read_shifts(spark, stored(spark, t.shifts(spark, sf_dir)))


@query
def read_shifts_wide(spark, sf_dir):
    return sources.read_shifts(spark, stored(spark, t.shifts_wide(spark, sf_dir)))


@query
def read_engine_hours(spark, sf_dir):
    return sources.read_engine_hours(spark, stored(spark, t.engine_entries(spark, sf_dir)), *TEN_DAYS)


@query
def level_csv_round_trip(spark, sf_dir):
    path = t.run_folder(spark)
    write_level_csv(ops.levels_5min(t.readings(spark, sf_dir)), path)
    return read_level_csv(spark, path)


@query
def materialized_levels(spark, sf_dir):
    path = t.run_folder(spark)
    materialize_levels(ops.levels_5min(t.readings(spark, sf_dir)), path)
    return read_levels(spark, path)


@query
def refreshed_levels(spark, sf_dir):
    """Levels stored before some days were complete, then made anew for those days."""
    readings, path = t.readings(spark, sf_dir), t.run_folder(spark)
    day = F.to_date(epoch_ms_to_ts("time_created"))
    late = day.isin([F.lit(d).cast("date") for d in t.LATE_DAYS])
    materialize_levels(ops.levels_5min(readings.filter(~late | (F.col("eqmt") % 3 == 0))), path)
    sources.refresh_levels(readings, path, t.LATE_DAYS)
    return read_levels(spark, path)


# Time and resampling


@query
def epoch_to_timestamp(spark, sf_dir):
    return t.readings(spark, sf_dir).select(
        "time_created",
        "eqmt",
        epoch_ms_to_ts("time_created", exact=False).alias("whole_second"),
        epoch_ms_to_ts("time_created").alias("exact"),
    )


@query
def time_buckets(spark, sf_dir):
    at = epoch_ms_to_ts(F.col("time_created"), exact=False)
    return t.readings(spark, sf_dir).select(
        "time_created", "eqmt", *[time_bucket(at, n).alias(f"bucket_{n}") for n in (20, 10, 5, 25)]
    )


@query
def time_buckets_modulo(spark, sf_dir):
    at = epoch_ms_to_ts(F.col("time_created"))
    return t.readings(spark, sf_dir).select(
        "time_created", "eqmt", time_bucket_modulo(at).alias("m10")
    )


@query
def range_filter(spark, sf_dir):
    return ops.range_filter(t.readings(spark, sf_dir, TEN_DAYS), *TEN_DAYS)


@query
def resample_avg_20(spark, sf_dir):
    return ops.resample_avg(t.readings(spark, sf_dir, MONTH), 20, MONTH)


@query
def resample_avg_10(spark, sf_dir):
    return ops.resample_avg(t.readings(spark, sf_dir), 10)


@query
def resample_avg_5(spark, sf_dir):
    return ops.resample_avg(t.readings(spark, sf_dir), 5)


@query
def with_previous(spark, sf_dir):
    return ops.with_previous(ops.resample_avg(t.readings(spark, sf_dir), 20))


@query
def levels_5min(spark, sf_dir):
    return ops.levels_5min(t.readings(spark, sf_dir))


@query
def levels_5min_ranged(spark, sf_dir):
    return ops.levels_5min_ranged(t.readings(spark, sf_dir), TEN_DAYS)


@query
def levels_5min_unranged(spark, sf_dir):
    return ops.levels_5min_ranged(t.readings(spark, sf_dir))


@query
def readings_with_bucket(spark, sf_dir):
    return ops.readings_with_bucket(t.readings(spark, sf_dir))


def _trace(form: str, **more) -> Query:
    def run(spark, sf_dir):
        return ops.level_trace(ops.levels_5min(t.readings(spark, sf_dir)), form, **more)

    return run


@query
def level_trace_delta(spark, sf_dir):
    return _trace(traces.DELTA, time_from=FROM_TIME, time_to=TO_TIME)(spark, sf_dir)


@query
def level_trace_fall(spark, sf_dir):
    return _trace(traces.FALL)(spark, sf_dir)


@query
def level_trace_fall_first(spark, sf_dir):
    """The listing form that stops at 1000 rows."""
    return _trace(traces.FALL, limit=1000)(spark, sf_dir)


@query
def level_trace_change(spark, sf_dir):
    return _trace(traces.CHANGE)(spark, sf_dir)


@query
def level_trace_ranged(spark, sf_dir):
    return ops.level_trace_ranged(t.readings(spark, sf_dir), *MONTH)


# Interval resolution


def _resolved(spark, sf_dir, rule: str, **more) -> DataFrame:
    readings = t.readings(spark, sf_dir)
    return ops.resolve_interval(
        t.requests(spark, sf_dir), calendar_of(readings), rule, readings=readings, **more
    )


@query
def interval_plus_12h(spark, sf_dir):
    return _resolved(spark, sf_dir, rules.PLUS_12H)


@query
def interval_plus_12h_rollover(spark, sf_dir):
    return _resolved(spark, sf_dir, rules.PLUS_12H_ROLLOVER)


@query
def interval_next_or_last_reading(spark, sf_dir):
    return _resolved(spark, sf_dir, rules.NEXT_OR_LAST_READING, validate=True)


@query
def interval_next_or_12h(spark, sf_dir):
    return _resolved(spark, sf_dir, rules.NEXT_OR_12H)


@query
def interval_next_only(spark, sf_dir):
    return _resolved(spark, sf_dir, rules.NEXT_ONLY)


@query
def interval_one_shift(spark, sf_dir):
    return _resolved(spark, sf_dir, rules.ONE_SHIFT)


@query
def interval_next_by_number(spark, sf_dir):
    return _resolved(spark, sf_dir, rules.NEXT_BY_NUMBER, tz="UTC")


@query
def interval_end_shift_start(spark, sf_dir):
    return _resolved(spark, sf_dir, rules.END_SHIFT_START)


@query
def interval_calendar_days(spark, sf_dir):
    return _resolved(spark, sf_dir, rules.CALENDAR_DAYS)


@query
def interval_calendar_days_full(spark, sf_dir):
    return _resolved(spark, sf_dir, rules.CALENDAR_DAYS_FULL)


@query
def interval_of_seconds(spark, sf_dir):
    return ops.interval_of_seconds(t.second_requests(spark, sf_dir))


@query
def validate_interval(spark, sf_dir):
    return ops.validate_interval(t.requests(spark, sf_dir))


# Fuel use


@query
def fuel_usage_quality(spark, sf_dir):
    return ops.fuel_usage_quality(t.readings(spark, sf_dir), *MONTH)


@query
def fuel_usage_quality_requests(spark, sf_dir):
    strict = F.col("t0") == TEN_DAYS[0]
    asked = t.second_requests(spark, sf_dir).withColumns(
        {
            "max_fuel_diff": F.when(strict, 50.0).otherwise(70.0),
            "perc_need_cab": F.when(strict, 0.3).otherwise(0.1),
        }
    )
    # One range is all history: nothing to prune.
    return ops.fuel_usage_quality_requests(t.readings(spark, sf_dir), asked, prune=False)


@query
def fuel_usage_quality_by_shift(spark, sf_dir):
    readings = t.readings(spark, sf_dir)
    return ops.fuel_usage_quality_by_shift(readings, calendar_of(readings), *MONTH)


@query
def fuel_usage_quality_loose_20(spark, sf_dir):
    return ops.fuel_usage_quality(t.readings(spark, sf_dir), *MONTH, limits=ops.LOOSE_LIMITS)


@query
def fuel_usage_quality_loose_10(spark, sf_dir):
    return ops.fuel_usage_quality(
        t.readings(spark, sf_dir), *TEN_DAYS, minutes=10, limits=ops.LOOSE_LIMITS
    )


@query
def fuel_usage_quality_by_shift_requests(spark, sf_dir):
    """Ranges and limits per request; where a request has none, the usual ones."""
    readings = t.readings(spark, sf_dir)
    asked = t.second_requests(spark, sf_dir).withColumn("max_fuel_diff", F.when(F.col("t0") == TEN_DAYS[0], 50.0))
    return ops.fuel_usage_quality_by_shift_requests(readings, asked, calendar_of(readings), prune=False)


def _over(method, rule: str, validate: bool = False, tz: str | None = None, **more):
    def run(spark, sf_dir):
        intervals = _resolved(spark, sf_dir, rule, validate=validate, tz=tz)
        # The windows span all history: nothing to prune.
        return method(t.readings(spark, sf_dir), intervals, prune=False, **more)

    return run


@query
def fuel_used_first_last(spark, sf_dir):
    return _over(ops.fuel_used_first_last, rules.PLUS_12H)(spark, sf_dir)


@query
def fuel_used_drops(spark, sf_dir):
    return _over(ops.fuel_used_drops, rules.PLUS_12H)(spark, sf_dir)


@query
def fuel_used_drops_capped(spark, sf_dir):
    return _over(ops.fuel_used_drops, rules.PLUS_12H, max_drop=200)(spark, sf_dir)


@query
def fuel_used_drops_to_end_shift(spark, sf_dir):
    return _over(ops.fuel_used_drops, rules.END_SHIFT_START)(spark, sf_dir)


def _limited(rule: str, method, limits, **more):
    """Requests with limits of their own, some of them unknown."""

    def run(spark, sf_dir):
        intervals = _resolved(spark, sf_dir, rule).withColumns({name: F.expr(limit) for name, limit in limits.items()})
        return method(t.readings(spark, sf_dir), intervals, prune=False, **more)

    return run


@query
def fuel_used_drops_limits(spark, sf_dir):
    return _limited(rules.PLUS_12H, ops.fuel_used_drops, t.DROP_LIMITS, max_drop=200)(spark, sf_dir)


@query
def clean_drop_rise_limits(spark, sf_dir):
    return _limited(rules.PLUS_12H_ROLLOVER, ops.clean_drop_rise, t.CLEAN_LIMITS)(spark, sf_dir)


@query
def clean_drop_rise_limits_uncapped(spark, sf_dir):
    return _limited(rules.PLUS_12H_ROLLOVER, ops.clean_drop_rise, t.CLEAN_LIMITS, cap_rises=False)(spark, sf_dir)


@query
def shift_fuel_report_limits(spark, sf_dir):
    """Thresholds per request."""
    asked = t.readings(spark, sf_dir).select("eqmt").distinct().withColumns(
        {
            "time_from": F.lit(FROM_TIME).cast("timestamp_ntz"),
            "time_to": F.lit(TO_TIME).cast("timestamp_ntz"),
            **{name: F.expr(limit) for name, limit in t.REPORT_LIMITS.items()},
        }
    )
    return ops.shift_fuel_report(t.readings(spark, sf_dir), ops.interval_of_times(asked), prune=False)


@query
def fuel_used_by_segment(spark, sf_dir):
    return _over(ops.fuel_used_by_segment, rules.PLUS_12H_ROLLOVER)(spark, sf_dir)


@query
def refuel_segments(spark, sf_dir):
    return _over(ops.refuel_segments, rules.PLUS_12H_ROLLOVER)(spark, sf_dir)


@query
def clean_drop_rise(spark, sf_dir):
    return _over(ops.clean_drop_rise, rules.PLUS_12H_ROLLOVER)(spark, sf_dir)


@query
def clean_drop_rise_uncapped(spark, sf_dir):
    return _over(ops.clean_drop_rise, rules.CALENDAR_DAYS_FULL, cap_rises=False)(spark, sf_dir)


@query
def shift_fuel_report(spark, sf_dir):
    """Every machine, every shift."""
    readings = t.readings(spark, sf_dir)
    return ops.shift_fuel_report_all(readings, calendar_of(readings))


@query
def shift_fuel_report_stored(spark, sf_dir):
    """The same from levels that were stored first."""
    readings = t.readings(spark, sf_dir)
    path = t.run_folder(spark)
    materialize_levels(ops.levels_5min(readings), path)
    return ops.shift_fuel_report_all(read_levels(spark, path), calendar_of(readings))


@query
def shift_fuel_report_stored_requests(spark, sf_dir):
    """Requests over stored levels, of which only the days and machines in question are opened."""
    intervals = _resolved(spark, sf_dir, rules.ONE_SHIFT)
    path = t.run_folder(spark)
    materialize_levels(ops.levels_5min(t.readings(spark, sf_dir)), path)
    return ops.shift_fuel_report(sources.read_levels_for(spark, path, intervals), intervals, prune=False)


@query
def shift_fuel_report_requests(spark, sf_dir):
    return _over(ops.shift_fuel_report, rules.ONE_SHIFT)(spark, sf_dir)


@query
def shift_fuel_report_window(spark, sf_dir):
    """An explicit window and thresholds instead of shifts."""
    asked = t.readings(spark, sf_dir).select("eqmt").distinct().withColumns(
        {
            "time_from": F.lit(FROM_TIME).cast("timestamp_ntz"),
            "time_to": F.lit(TO_TIME).cast("timestamp_ntz"),
        }
    )
    return ops.shift_fuel_report(
        t.readings(spark, sf_dir),
        ops.interval_of_times(asked),
        perc_no_data=60,
        perc_need_cab=40,
        prune=False,
    )


@query
def fuel_level_difference(spark, sf_dir):
    return _over(ops.fuel_level_difference, rules.NEXT_BY_NUMBER, tz="UTC")(spark, sf_dir)


@query
def fuel_used_raw_drops(spark, sf_dir):
    return _over(ops.fuel_used_raw_drops, rules.NEXT_ONLY)(spark, sf_dir)


@query
def analyze_fuel(spark, sf_dir):
    return _over(ops.analyze_fuel, rules.NEXT_OR_12H)(spark, sf_dir)


@query
def fuel_between_confirmed_refills(spark, sf_dir):
    return _over(
        ops.fuel_between_confirmed_refills, rules.NEXT_OR_LAST_READING, validate=True
    )(spark, sf_dir)


def _over_edges(method, rule: str, validate: bool = False, tz: str | None = None):
    """The same over readings with unknown levels, copies and ties."""

    def run(spark, sf_dir):
        readings = t.edge_readings(spark, sf_dir)
        intervals = rules.resolve_interval(
            t.requests(spark, sf_dir), calendar_of(readings), rule, readings=readings, validate=validate, tz=tz
        )
        return method(readings, intervals, prune=False)

    return run


@query
def edge_fuel_usage_quality(spark, sf_dir):
    return ops.fuel_usage_quality(t.edge_readings(spark, sf_dir), *MONTH)


@query
def edge_fuel_used_first_last(spark, sf_dir):
    return _over_edges(ops.fuel_used_first_last, rules.PLUS_12H)(spark, sf_dir)


@query
def edge_fuel_level_difference(spark, sf_dir):
    return _over_edges(ops.fuel_level_difference, rules.NEXT_BY_NUMBER, tz="UTC")(spark, sf_dir)


@query
def edge_fuel_used_raw_drops(spark, sf_dir):
    return _over_edges(ops.fuel_used_raw_drops, rules.NEXT_ONLY)(spark, sf_dir)


@query
def edge_analyze_fuel(spark, sf_dir):
    return _over_edges(ops.analyze_fuel, rules.NEXT_OR_12H)(spark, sf_dir)


@query
def edge_fuel_between_confirmed_refills(spark, sf_dir):
    return _over_edges(
        ops.fuel_between_confirmed_refills, rules.NEXT_OR_LAST_READING, validate=True
    )(spark, sf_dir)


@query
def engine_hours(spark, sf_dir):
    return ops.engine_hours(
        t.engine_entries(spark, sf_dir),
        t.second_requests(spark, sf_dir),
        t.idle_intervals(spark, sf_dir),
        prune=False,
    )


@query
def engine_hours_literal(spark, sf_dir):
    return ops.engine_hours(
        t.engine_entries(spark, sf_dir),
        t.second_requests(spark, sf_dir),
        t.idle_intervals(spark, sf_dir),
        literal=True,
    )


@query
def idle_seconds(spark, sf_dir):
    return ops.idle_seconds(t.second_requests(spark, sf_dir), t.idle_intervals(spark, sf_dir))


@query
def compare_methods(spark, sf_dir):
    readings = t.readings(spark, sf_dir)
    return ops.compare_methods(readings, calendar_of(readings), t.requests(spark, sf_dir), prune=False)


# Profiling and checks


@query
def bucket_count(spark, sf_dir):
    return profile.bucket_count(t.readings(spark, sf_dir), 20, MONTH)


@query
def max_level(spark, sf_dir):
    return profile.max_level(t.readings(spark, sf_dir))


@query
def max_level_per_equipment(spark, sf_dir):
    return profile.max_level_per_equipment(t.readings(spark, sf_dir))


@query
def distinct_levels(spark, sf_dir):
    return profile.distinct_levels(t.readings(spark, sf_dir))


@query
def distinct_raw(spark, sf_dir):
    return profile.distinct_raw(t.readings(spark, sf_dir))


@query
def distinct_equipment(spark, sf_dir):
    return profile.distinct_equipment(t.readings(spark, sf_dir))


@query
def day_span_of_levels(spark, sf_dir):
    return profile.day_span_of_levels(ops.levels_5min(t.readings(spark, sf_dir)))


@query
def day_span_of_readings(spark, sf_dir):
    return profile.day_span_of_readings(t.readings(spark, sf_dir))


@query
def time_span_of_levels(spark, sf_dir):
    return profile.time_span_of_levels(ops.levels_5min(t.readings(spark, sf_dir)))


@query
def reading_count(spark, sf_dir):
    return profile.reading_count(t.readings(spark, sf_dir))


@query
def levels_between(spark, sf_dir):
    return profile.levels_between(ops.levels_5min(t.readings(spark, sf_dir)), FROM_TIME, TO_TIME)


@query
def levels_between_count(spark, sf_dir):
    levels = ops.levels_5min(t.readings(spark, sf_dir))
    return profile.levels_between(levels, FROM_TIME, TO_TIME).agg(
        F.count(F.lit(1)).alias("row_count")
    )


@query
def levels_between_first_10(spark, sf_dir):
    levels = ops.levels_5min(t.readings(spark, sf_dir))
    return profile.levels_between(levels, FROM_TIME, TO_TIME, limit=10)


@query
def readings_between(spark, sf_dir):
    return profile.readings_between(t.readings(spark, sf_dir), *TEN_DAYS)


@query
def readings_between_positive(spark, sf_dir):
    return profile.readings_between(t.readings(spark, sf_dir), *MONTH, positive=True)


@query
def shift_listing_from(spark, sf_dir):
    return profile.shift_listing(t.shifts(spark, sf_dir), date_from="2024-01-10")


@query
def shift_listing_of(spark, sf_dir):
    return profile.shift_listing(t.shifts(spark, sf_dir), date_of="2024-01-10")


@query
def shift_listing_to(spark, sf_dir):
    return profile.shift_listing(t.shifts(spark, sf_dir), date_to="2024-01-20", descending=True)
