from .compare import compare_methods
from .confirmed_refills import fuel_between_confirmed_refills
from .drops import (
    clean_drop_rise,
    fuel_used_by_segment,
    fuel_used_drops,
    fuel_used_first_last,
    refuel_segments,
)
from .engine_hours import engine_hours, idle_seconds
from .intervals import (
    interval_of_seconds,
    interval_of_times,
    resolve_interval,
    validate_interval,
)
from .quality import (
    DEFAULT_LIMITS,
    LOOSE_LIMITS,
    QualityLimits,
    fuel_usage_quality,
    fuel_usage_quality_by_shift,
    fuel_usage_quality_by_shift_requests,
    fuel_usage_quality_requests,
)
from .raw_levels import fuel_level_difference, fuel_used_raw_drops, level_as_of
from .refuels import analyze_fuel
from .resample import (
    levels_5min,
    levels_5min_ranged,
    range_filter,
    readings_with_bucket,
    resample_avg,
    resampled,
    with_previous,
)
from .shift_report import shift_fuel_report, shift_fuel_report_all
from .spans import needed_readings, rows_in_spans, spans_of, totals_in_spans
from .traces import level_trace, level_trace_ranged

__all__ = [
    "DEFAULT_LIMITS",
    "LOOSE_LIMITS",
    "QualityLimits",
    "analyze_fuel",
    "clean_drop_rise",
    "compare_methods",
    "engine_hours",
    "fuel_between_confirmed_refills",
    "fuel_level_difference",
    "fuel_usage_quality",
    "fuel_usage_quality_by_shift",
    "fuel_usage_quality_by_shift_requests",
    "fuel_usage_quality_requests",
    "fuel_used_by_segment",
    "fuel_used_drops",
    "fuel_used_first_last",
    "fuel_used_raw_drops",
    "idle_seconds",
    "interval_of_seconds",
    "interval_of_times",
    "level_as_of",
    "level_trace",
    "level_trace_ranged",
    "levels_5min",
    "levels_5min_ranged",
    "needed_readings",
    "range_filter",
    "readings_with_bucket",
    "refuel_segments",
    "resample_avg",
    "resampled",
    "resolve_interval",
    "rows_in_spans",
    "shift_fuel_report",
    "shift_fuel_report_all",
    "spans_of",
    "totals_in_spans",
    "validate_interval",
    "with_previous",
]
