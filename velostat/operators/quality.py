"""Data-quality profile of the raw trip tables.

All count-type checks are conditional aggregates (``count_if``), so any set
of them runs as one scan with a partial aggregate per task; the
``quality_report`` fuses them.  Rule builders return plain Columns over the
raw source shape, so a check is defined once and reused by the fused report
and by the single-check queries.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velostat import constants as K
from velostat.functions import elapsed


def any_null(cols: Sequence[str]) -> Column:
    cond = None
    for c in cols:
        part = F.col(c).isNull()
        cond = part if cond is None else (cond | part)
    return cond


def quality_report(df: DataFrame, measures: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """One aggregate row per group with every measure (already aggregate
    expressions, e.g. ``F.count_if(rule)``)."""
    aggs = [m.alias(name) for name, m in measures.items()]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def count_rules(rules: Mapping[str, Column]) -> dict[str, Column]:
    """``count_if`` over each boolean rule (NULL is not counted)."""
    return {name: F.count_if(rule) for name, rule in rules.items()}


# ------------------------------------------------------------ legacy shape
LEGACY_IDS = ("trip_id", "bikeid", "from_station_id", "to_station_id")


def legacy_rules(as_of_year: int = K.AS_OF_YEAR) -> dict[str, Column]:
    dur = elapsed("SECOND", "start_time", "end_time")
    minutes = elapsed("MINUTE", "start_time", "end_time")
    lo, hi = K.BIRTH_YEAR_RANGE
    return {
        "missing_id_rows": any_null(LEGACY_IDS),
        "missing_name_or_user": any_null(("from_station_name", "to_station_name", "usertype")),
        "missing_gender_or_birth": any_null(("gender", "birthyear")),
        "constraint_violation": (F.col("bikeid") <= 0) | (F.col("tripduration") <= 0),
        "logical_issues": (F.col("start_time") > F.col("end_time"))
        | (F.col("tripduration") != dur)
        | (F.col("birthyear") < lo)
        | (F.col("birthyear") > hi),
        "duration_mismatch": F.col("tripduration") != dur,
        "duration_mismatch_over_1min": F.abs(F.col("tripduration") - dur) > 60,
        "long_rentals": dur > K.MONTH_SECONDS,
        "short_round_trips_le_3min": (minutes <= 3) & (F.col("from_station_name") == F.col("to_station_name")),
        "implausible_age": (F.lit(as_of_year) - F.col("birthyear")) > K.MAX_PLAUSIBLE_AGE,
        "inverted_times": F.col("start_time") > F.col("end_time"),
    }


# ------------------------------------------------------------ modern shape
MODERN_IDS = ("ride_id", "start_station_id", "end_station_id")


def invalid_coordinate_rule() -> Column:
    """NULL or out-of-range latitude/longitude at either end."""
    bad = None
    for c, lim in (("start_lat", 90), ("end_lat", 90), ("start_lng", 180), ("end_lng", 180)):
        part = F.col(c).isNull() | (F.abs(F.col(c)) > lim)
        bad = part if bad is None else (bad | part)
    return bad


def modern_rules() -> dict[str, Column]:
    dur = elapsed("SECOND", "started_at", "ended_at")
    minutes = elapsed("MINUTE", "started_at", "ended_at")
    same_station = F.col("start_station_name") == F.col("end_station_name")
    return {
        "missing_id_rows": any_null(MODERN_IDS),
        "missing_destination": F.col("end_station_id").isNull(),
        "long_rentals": dur > K.MONTH_SECONDS,
        "short_round_trips_lt_2min": (minutes < 2) & same_station,
        "short_round_trips_lt_3min": (minutes < 3) & same_station,
        "inverted_times": F.col("started_at") > F.col("ended_at"),
        "invalid_coordinates": invalid_coordinate_rule(),
    }


def legacy_report(df: DataFrame, as_of_year: int = K.AS_OF_YEAR) -> DataFrame:
    dur = elapsed("SECOND", "start_time", "end_time")
    measures = {"n_rows": F.count(F.lit(1)), **count_rules(legacy_rules(as_of_year)),
                "max_duration_sec": F.max(dur)}
    return quality_report(df, measures)


def modern_report(df: DataFrame) -> DataFrame:
    dur = elapsed("SECOND", "started_at", "ended_at")
    measures = {"n_rows": F.count(F.lit(1)), **count_rules(modern_rules()), "max_duration_sec": F.max(dur)}
    return quality_report(df, measures)


# ---------------------------------------------------------- row-returning
def longest(df: DataFrame, order_col: str | Column, name: str, cols: Sequence[str]) -> DataFrame:
    """All rows, the largest ``order_col`` first (ties by the other projected
    columns).  A global sort: rows are range-partitioned, then sorted within."""
    oc = F.col(order_col) if isinstance(order_col, str) else order_col
    out = df.select(oc.alias(name), *cols)
    return out.orderBy(F.col(name).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in cols])


def duplicate_keys(df: DataFrame, key: str = "trip_id", name: str = "num_of_dup") -> DataFrame:
    """Keys that occur more than once, with their multiplicity."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, null_count)`` for every column — one aggregate pass,
    then unpivoted (the aggregate row is one row wide)."""
    columns = list(columns) if columns else df.columns
    agg = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    return agg.unpivot([], columns, "column_name", "null_count")


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: ``null_count``, ``n_rows`` and ``is_constant`` (exactly one
    distinct value, NULL counting as a value).

    Tested as ``min = max`` plus the NULL count — one pass of plain
    min/max/count aggregates instead of one COUNT(DISTINCT) per column
    (which would expand every row once per column).
    """
    columns = list(columns) if columns else df.columns
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(columns):
        cc = F.col(f"`{c}`")
        aggs += [F.min(cc).cast("string").alias(f"__mn{i}"), F.max(cc).cast("string").alias(f"__mx{i}"),
                 F.count_if(cc.isNull()).alias(f"__nn{i}")]
    one = df.agg(*aggs)
    structs = []
    for i, c in enumerate(columns):
        nn, rows = F.col(f"__nn{i}"), F.col("__rows")
        const = ((F.col(f"__mn{i}") == F.col(f"__mx{i}")) & (nn == 0)) | (nn == rows)
        structs.append(F.struct(F.lit(c).alias("column_name"), nn.alias("null_count"),
                                rows.alias("n_rows"), F.coalesce(const, F.lit(False)).alias("is_constant")))
    return one.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
