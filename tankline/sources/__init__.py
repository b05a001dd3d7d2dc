from .calendar import calendar_between, calendar_of, wide_calendar
from .files import (
    drop_levels,
    materialize_levels,
    newest_readings,
    read_engine_hours,
    read_level_csv,
    read_levels,
    read_levels_for,
    read_readings,
    read_shifts,
    refresh_levels,
    store_readings,
    stored_levels,
    write_level_csv,
)

__all__ = [
    "calendar_between",
    "calendar_of",
    "drop_levels",
    "materialize_levels",
    "newest_readings",
    "read_engine_hours",
    "read_level_csv",
    "read_levels",
    "read_levels_for",
    "read_readings",
    "read_shifts",
    "refresh_levels",
    "store_readings",
    "stored_levels",
    "wide_calendar",
    "write_level_csv",
]
