from .numbers import fixed3, round_half_up, share_percent, step
from .times import (
    DAY_MS,
    epoch_ms_to_ts,
    epoch_second_range,
    time_bucket,
    time_bucket_modulo,
    wall_clock_ms,
)

__all__ = [
    "DAY_MS",
    "epoch_ms_to_ts",
    "epoch_second_range",
    "fixed3",
    "round_half_up",
    "share_percent",
    "step",
    "time_bucket",
    "time_bucket_modulo",
    "wall_clock_ms",
]
