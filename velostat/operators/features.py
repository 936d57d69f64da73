"""Row-level derived features (one projection each, codegen-friendly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velostat import constants as K
from velostat.functions import (
    cut,
    elapsed_minutes,
    in_hour_windows,
    null_safe_key,
    weekday_label,
    weekday_number,
)


def enrich_trips(df: DataFrame) -> DataFrame:
    """Add ``route_id, weekday, weekday_num, duration_min, start_hour,
    is_weekend, round_trip`` to canonical trips.

    ``route_id`` is ``<start id>_<end id>`` with a missing id written ``NA``;
    ``weekday`` is ``Sun``..``Sat`` and ``weekday_num`` 1 (Sunday)..7;
    ``round_trip`` is NULL when either station is unknown.
    """
    return df.select(
        "*",
        null_safe_key("start_station_id", "end_station_id").alias("route_id"),
        weekday_label("start_time").alias("weekday"),
        weekday_number("start_time").alias("weekday_num"),
        elapsed_minutes("start_time", "end_time").alias("duration_min"),
        F.hour("start_time").alias("start_hour"),
        weekday_number("start_time").isin(1, 7).alias("is_weekend"),
        (F.col("start_station_id") == F.col("end_station_id")).alias("round_trip"),
    )


def with_peak_flag(
    df: DataFrame, windows: Sequence[tuple[int, int]] = K.PEAK_WINDOWS, hour: str = "start_hour"
) -> DataFrame:
    """``is_peak``: the start hour lies in one of the inclusive hour windows."""
    return df.withColumn("is_peak", in_hour_windows(hour, windows))


def with_age_group(
    df: DataFrame, breaks: Sequence[int | None] = K.AGE_BREAKS, age: str = "age",
    label: str = "age_group", rank: str = "age_rank",
) -> DataFrame:
    """Left-closed age bins ``[a,b)`` and their ordinal rank; NULL outside."""
    lab, rnk = cut(age, breaks)
    return df.withColumn(label, lab).withColumn(rank, rnk)


def with_duration_log10(df: DataFrame, value: str = "duration_sec", name: str = "duration_log10") -> DataFrame:
    """``log10(value + 1)``."""
    return df.withColumn(name, F.log10(F.col(value) + F.lit(1)))
