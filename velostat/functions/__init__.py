from velostat.functions.columns import (  # noqa: F401
    add_seconds,
    bisect_left,
    bisect_right,
    cut,
    elapsed,
    elapsed_minutes,
    in_hour_windows,
    null_safe_key,
    round_half_even,
    safe_ratio,
    weekday_label,
    weekday_number,
)
