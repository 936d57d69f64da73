"""Ride-pattern profile: counts by hour/weekday, the hour threshold table,
peak shares, within-group shares (round trips, weekends, age groups)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velostat import constants as K
from velostat.functions import round_half_even, safe_ratio
from velostat.operators.stats import count_share, densify, join_groups


def trips_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``n`` = number of trips per combination of ``keys`` (NULL is a group)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def hour_threshold(df: DataFrame, by: Sequence[str] = ("year",)) -> DataFrame:
    """Trips per start hour, all 24 hours present (0 when none), ranked by
    count (ties: earlier hour first), with

    * ``pct_to_max`` = n / busiest hour's n × 100, half-even rounded to 2 dp
      (100 on the first row);
    * ``delta_to_above`` = (1 − n / previous row's n) × 100, rounded likewise
      (0 on the first row; NULL when the previous count is 0).

    The window is partitioned by ``by``: at most 24 rows per partition.
    """
    by = list(by)
    counts = trips_by(df, by + ["start_hour"])
    dense = densify(counts, by, "start_hour", 0, 23, {"n": 0}, bounded=True)
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col("start_hour").asc())
    whole = Window.partitionBy(*by)
    rank = F.row_number().over(order)
    ranked = dense.select(
        *by, "start_hour", "n",
        rank.alias("hour_rank"),
        F.max("n").over(whole).alias("__max"),
        F.lag("n").over(order).alias("__prev"),
    )
    return ranked.select(
        *by, "start_hour", "n", "hour_rank",
        F.when(F.col("hour_rank") == 1, F.lit(100.0))
        .otherwise(round_half_even(safe_ratio("n", "__max") * 100, 2)).alias("pct_to_max"),
        F.when(F.col("hour_rank") == 1, F.lit(0.0))
        .otherwise(round_half_even((F.lit(1.0) - safe_ratio("n", "__prev")) * 100, 2))
        .alias("delta_to_above"),
    )


def peak_hours_detected(
    threshold: DataFrame, cutoff_pct: float = K.PEAK_CUTOFF_PCT, flat_delta_pct: float = K.ADJACENT_DELTA_PCT,
) -> DataFrame:
    """Data-driven peak hours: hours whose count is at least ``cutoff_pct``
    percent of the busiest hour (on the rounded ``pct_to_max``).

    ``flat_step`` marks hours whose drop from the hour ranked above is below
    ``flat_delta_pct`` percent — where the ranked curve flattens, the break
    point used to choose the cut-off."""
    return threshold.where(F.col("pct_to_max") >= F.lit(cutoff_pct)).withColumn(
        "flat_step", F.col("delta_to_above") < F.lit(flat_delta_pct))


def peak_cutoff(
    threshold: DataFrame, by: Sequence[str] = ("year",), flat_delta_pct: float = K.ADJACENT_DELTA_PCT,
    run: int = K.FLAT_RUN,
) -> DataFrame:
    """The break point of each ranked hour curve, one row per group of ``by``.

    A step is flat when an hour's count is less than ``flat_delta_pct`` percent
    below that of the hour ranked above.  The curve breaks at the hour that
    begins the first ``run`` flat steps in a row: from there on the hours are
    alike, above it they stand out.  Columns: ``break_rank`` and
    ``break_hour``, ``detected_cutoff`` (the hour's ``pct_to_max``) and
    ``flat_steps`` (the length of that run).  A curve without such a run has no
    break: NULLs, and 0 steps.

    Runs are found without a loop: flat steps numbered among all ranks and
    among flat ranks differ by a constant within a run.  Windows hold the 24
    hours (and an unknown one) of a group.
    """
    by = list(by)
    order = Window.partitionBy(*by).orderBy("hour_rank")
    flat = F.coalesce((F.col("hour_rank") > 1) & (F.col("delta_to_above") < F.lit(flat_delta_pct)), F.lit(False))
    steps = threshold.withColumn("__flat", flat)
    steps = steps.withColumn("__run", F.col("hour_rank") - F.sum(F.col("__flat").cast("int")).over(order))
    runs = steps.groupBy(*by, "__run").agg(
        F.count_if("__flat").alias("flat_steps"),
        F.min_by(F.struct(F.col("hour_rank").alias("r"), F.col("start_hour").alias("h"), F.col("pct_to_max").alias("c")),
                 F.when(F.col("__flat"), F.col("hour_rank"))).alias("__first"),
    )
    long = F.col("flat_steps") >= run
    first = F.min(F.when(long, F.struct(F.col("__first.r").alias("r"), "__first", "flat_steps")))
    out = runs.groupBy(*by).agg(first.alias("__b"))
    return out.select(
        *by, F.col("__b.r").alias("break_rank"), F.col("__b.__first.h").alias("break_hour"),
        F.col("__b.__first.c").alias("detected_cutoff"),
        F.coalesce("__b.flat_steps", F.lit(0).cast("bigint")).alias("flat_steps"),
    )


def peak_hours_by_curve(
    threshold: DataFrame, by: Sequence[str] = ("year",), flat_delta_pct: float = K.ADJACENT_DELTA_PCT,
    run: int = K.FLAT_RUN,
) -> DataFrame:
    """Peak hours whose cut-off is found from the curve itself: the hours of
    each group with at least its :func:`peak_cutoff`, which they carry as
    ``detected_cutoff``.  A curve without a break has no peak hours."""
    cutoff = peak_cutoff(threshold, by, flat_delta_pct, run).select(*by, "detected_cutoff")
    return join_groups(threshold, cutoff, by).where(F.col("pct_to_max") >= F.col("detected_cutoff"))


def peak_share(df: DataFrame, keys: Sequence[str] = ("year", "user_type")) -> DataFrame:
    """``n_peak``, ``n_total`` and ``peak_pct`` (percent) per group — one pass
    with conditional aggregates instead of one pass per ratio."""
    out = df.groupBy(*keys).agg(
        F.count_if(F.col("is_peak")).alias("n_peak"), F.count(F.lit(1)).alias("n_total")
    )
    return out.withColumn("peak_pct", F.col("n_peak") / F.col("n_total") * 100)


def pivot_years(
    df: DataFrame, index: Sequence[str], value: str, years: Sequence[int], prefix: str
) -> DataFrame:
    """One column per year (``<prefix>_<year>``) for ``value``; the year list is
    given, so no job runs to discover it."""
    out = df.groupBy(*index).pivot("year", list(years)).agg(F.first(value))
    return out.select(*index, *[F.col(f"`{y}`").alias(f"{prefix}_{y}") for y in years])


def round_trip_share(df: DataFrame, keys: Sequence[str] = ("year", "user_type")) -> DataFrame:
    keys = list(keys)
    return count_share(df, keys + ["round_trip"], keys, scale=100.0, name="pct_round_trip")


def weekend_share(df: DataFrame, keys: Sequence[str] = ("year", "user_type"), scale: float = 1.0) -> DataFrame:
    keys = list(keys)
    return count_share(df, keys + ["is_weekend"], keys, scale=scale, name="pct")


def weekend_only_share(df: DataFrame, keys: Sequence[str] = ("year", "user_type")) -> DataFrame:
    """Weekend rows of :func:`weekend_share` in percent (share taken first)."""
    return weekend_share(df, keys, scale=100.0).where(F.col("is_weekend"))


def age_user_mix(demo: DataFrame, group: str = "age_group") -> DataFrame:
    """Trips per (age group, user type) and the user-type share within each age group."""
    return count_share(demo, [group, "user_type"], [group], scale=1.0, name="pct")


def age_membership_rate(demo: DataFrame, group: str = "age_group", member: str = "member") -> DataFrame:
    """Member share (percent, 2 dp half-even) per age group; filtered after the share."""
    shares = count_share(demo, [group, "user_type"], [group], scale=100.0, name="pct")
    return shares.withColumn("pct", round_half_even("pct", 2)).where(F.col("user_type") == member)
