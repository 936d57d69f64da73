"""Named queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the test tables under ``sf_dir`` (through the two source
shapes) and returns a lazy DataFrame over all of their rows: apart from the
curated trip tables, written at their first use, no job runs and nothing is
written while a query is built.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velostat import constants as K
from velostat.functions import elapsed
from velostat.operators import profile, quality, routes, stats
from velostat.operators.features import with_age_group, with_duration_log10
from velostat.operators.normalize import (
    normalize_legacy,
    normalize_modern,
    recode_user_type,
    repair_duration,
    valid_trips,
)
from velostat.plans import datasets as D
from velostat.sources.export import bi_prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

YEAR_USER = ("year", "user_type")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ------------------------------------------------------ normalise / features
@query
def scan_legacy(spark, sf):
    return D.legacy_raw(spark, sf)


@query
def scan_modern(spark, sf):
    return D.modern_raw(spark, sf)


@query
def normalize_legacy_q(spark, sf):
    return normalize_legacy(D.legacy_raw(spark, sf))


@query
def normalize_modern_q(spark, sf):
    return normalize_modern(D.modern_raw(spark, sf))


@query
def repair_duration_q(spark, sf):
    return repair_duration(D.legacy_raw(spark, sf))


@query
def valid_trips_q(spark, sf):
    return valid_trips(D.modern_raw(spark, sf))


@query
def demographic_trips_q(spark, sf):
    return D.demo_trips(spark, sf).select(
        "trip_id", "user_type", "gender", "birth", "age", "duration_sec", "start_time"
    )


@query
def recode_user_type_q(spark, sf):
    """Source label → canonical label, with trip counts (unmapped → NULL)."""
    df = recode_user_type(
        D.legacy_raw(spark, sf).withColumnRenamed("usertype", "user_type"), source_column="source_user_type"
    )
    return df.groupBy("source_user_type", "user_type").agg(F.count(F.lit(1)).alias("n"))


@query
def enrich_trips_q(spark, sf):
    return D.trips(spark, sf).drop("is_peak")


@query
def peak_flag(spark, sf):
    return D.trips(spark, sf).select("year", "trip_id", "start_time", "start_hour", "is_peak")


@query
def age_groups(spark, sf):
    return D.demo_trips(spark, sf).select("trip_id", "age", "age_group", "age_rank")


@query
def age_groups_coarse(spark, sf):
    df = with_age_group(D.demo_trips(spark, sf).select("trip_id", "age"), K.AGE_BREAKS_COARSE,
                        label="age_band", rank="age_band_rank")
    return df.select("trip_id", "age", "age_band", "age_band_rank")


@query
def duration_log10(spark, sf):
    return with_duration_log10(D.trips(spark, sf).select("year", "trip_id", "duration_sec"))


@query
def entire_data(spark, sf):
    return D.trips(spark, sf)


@query
def constant_columns(spark, sf):
    return quality.constant_columns(D.modern_raw(spark, sf))


# ------------------------------------------------------------------ quality
@query
def longest_trips_legacy(spark, sf):
    return quality.longest(D.legacy_raw(spark, sf), "tripduration", "tripduration",
                           ["start_time", "end_time"])


@query
def longest_trips_modern(spark, sf):
    df = D.modern_raw(spark, sf)
    return quality.longest(df, elapsed("MINUTE", "started_at", "ended_at"), "trip_duration_minutes",
                           ["ride_id", "started_at", "ended_at"])


def _legacy_checks(spark, sf, names):
    rules = quality.legacy_rules()
    return quality.quality_report(D.legacy_raw(spark, sf), quality.count_rules({n: rules[n] for n in names}))


def _modern_checks(spark, sf, names):
    rules = quality.modern_rules()
    return quality.quality_report(D.modern_raw(spark, sf), quality.count_rules({n: rules[n] for n in names}))


@query
def missing_id_rows(spark, sf):
    return _legacy_checks(spark, sf, ["missing_id_rows"]).withColumnRenamed("missing_id_rows", "missing_value")


@query
def null_profile(spark, sf):
    return quality.null_profile(D.legacy_raw(spark, sf))


@query
def null_profile_modern(spark, sf):
    return quality.null_profile(D.modern_raw(spark, sf))


@query
def constraint_violations(spark, sf):
    return _legacy_checks(spark, sf, ["constraint_violation"])


@query
def logical_issues(spark, sf):
    return _legacy_checks(spark, sf, ["logical_issues"])


@query
def duplicate_trip_ids(spark, sf):
    return quality.duplicate_keys(D.legacy_raw(spark, sf), "trip_id")


@query
def duplicate_ride_ids(spark, sf):
    return quality.duplicate_keys(D.modern_raw(spark, sf), "ride_id")


@query
def short_round_trips(spark, sf):
    legacy = _legacy_checks(spark, sf, ["short_round_trips_le_3min"]).withColumn("year", F.lit(K.LEGACY_YEAR))
    modern = _modern_checks(spark, sf, ["short_round_trips_lt_2min", "short_round_trips_lt_3min"]).withColumn(
        "year", F.lit(K.MODERN_YEAR))
    return legacy.unionByName(modern, allowMissingColumns=True)


def _both_years(spark, sf, legacy_names, modern_names, extra=None):
    rl, rm = quality.legacy_rules(), quality.modern_rules()
    ml = quality.count_rules({n: rl[n] for n in legacy_names})
    mm = quality.count_rules({n: rm[n] for n in modern_names})
    if extra:
        ml.update(extra[0])
        mm.update(extra[1])
    a = quality.quality_report(D.legacy_raw(spark, sf), ml).withColumn("year", F.lit(K.LEGACY_YEAR))
    b = quality.quality_report(D.modern_raw(spark, sf), mm).withColumn("year", F.lit(K.MODERN_YEAR))
    return a.unionByName(b)


@query
def long_rentals(spark, sf):
    mx = ({"max_duration_sec": F.max(elapsed("SECOND", "start_time", "end_time"))},
          {"max_duration_sec": F.max(elapsed("SECOND", "started_at", "ended_at"))})
    return _both_years(spark, sf, ["long_rentals"], ["long_rentals"], mx)


@query
def implausible_age(spark, sf):
    return _legacy_checks(spark, sf, ["implausible_age"])


@query
def duration_mismatch(spark, sf):
    return _legacy_checks(spark, sf, ["duration_mismatch", "duration_mismatch_over_1min"])


@query
def missing_destination(spark, sf):
    return D.modern_raw(spark, sf).where(F.col("end_station_id").isNull())


@query
def inverted_times(spark, sf):
    return _both_years(spark, sf, ["inverted_times"], ["inverted_times"])


@query
def invalid_coordinates(spark, sf):
    return _modern_checks(spark, sf, ["invalid_coordinates"])


@query
def quality_report(spark, sf):
    a = quality.legacy_report(D.legacy_raw(spark, sf)).withColumn("year", F.lit(K.LEGACY_YEAR))
    b = quality.modern_report(D.modern_raw(spark, sf)).withColumn("year", F.lit(K.MODERN_YEAR))
    return a.unionByName(b, allowMissingColumns=True)


# ------------------------------------------------------------------ profile
@query
def trips_by_hour_weekday(spark, sf):
    return profile.trips_by(D.trips(spark, sf), ["year", "user_type", "start_hour", "weekday", "weekday_num"])


@query
def trips_by_hour_user(spark, sf):
    return profile.trips_by(D.trips(spark, sf), ["year", "user_type", "start_hour"])


@query
def hour_threshold(spark, sf):
    return profile.hour_threshold(D.trips(spark, sf), ["year"])


@query
def peak_hours_detected(spark, sf):
    return profile.peak_hours_detected(profile.hour_threshold(D.trips(spark, sf), ["year"]))


@query
def peak_cutoff(spark, sf):
    return profile.peak_cutoff(profile.hour_threshold(D.trips(spark, sf), ["year"]))


@query
def peak_cutoff_user(spark, sf):
    """The break point of each user type's own hour curve."""
    return profile.peak_cutoff(profile.hour_threshold(D.trips(spark, sf), YEAR_USER), YEAR_USER)


@query
def peak_hours_by_curve(spark, sf):
    return profile.peak_hours_by_curve(profile.hour_threshold(D.trips(spark, sf), ["year"]))


@query
def peak_share(spark, sf):
    return profile.peak_share(D.trips(spark, sf), YEAR_USER)


@query
def peak_share_demo(spark, sf):
    """Peak share with the legacy year cut to riders with demographics."""
    return profile.peak_share(D.trips(spark, sf, "demo"), YEAR_USER)


@query
def peak_share_trimmed(spark, sf):
    """Peak share after removing each group's duration outliers (IQR fences)."""
    t = D.trips(spark, sf).select("year", "user_type", "duration_sec", "is_peak")
    kept = F.col("known") - F.col("outlier_left") - F.col("outlier_right")
    out = stats.outlier_summary(t, YEAR_USER, by=["is_peak"]).groupBy(*YEAR_USER).agg(
        F.coalesce(F.sum(F.when(F.col("is_peak"), kept)), F.lit(0).cast("bigint")).alias("n_peak"),
        F.sum(kept).alias("n_total"),
    ).where(F.col("n_total") > 0)
    return out.withColumn("peak_pct", F.col("n_peak") / F.col("n_total") * 100)


@query
def yoy_peak_share(spark, sf):
    full = profile.peak_share(D.trips(spark, sf), YEAR_USER)
    wide = profile.pivot_years(full, ["user_type"], "peak_pct", [K.LEGACY_YEAR, K.MODERN_YEAR], "peak_pct")
    a, b = f"peak_pct_{K.LEGACY_YEAR}", f"peak_pct_{K.MODERN_YEAR}"
    return wide.withColumn("peak_pct_change", F.col(b) - F.col(a))


@query
def round_trip_share(spark, sf):
    return profile.round_trip_share(D.trips(spark, sf), YEAR_USER)


@query
def weekend_share(spark, sf):
    return profile.weekend_share(D.trips(spark, sf), YEAR_USER)


@query
def weekend_only_share(spark, sf):
    return profile.weekend_only_share(D.trips(spark, sf), YEAR_USER)


@query
def age_user_mix(spark, sf):
    return profile.age_user_mix(D.demo_trips(spark, sf))


@query
def age_membership_rate(spark, sf):
    return profile.age_membership_rate(D.demo_trips(spark, sf))


# ------------------------------------------------------------------- spread
def _iqr(df, keys=YEAR_USER):
    return stats.iqr_summary(df.select(*keys, "duration_sec"), keys)


@query
def iqr_all(spark, sf):
    return _iqr(D.trips(spark, sf))


@query
def iqr_all_demo(spark, sf):
    return _iqr(D.trips(spark, sf, "demo"))


@query
def iqr_peak(spark, sf):
    return _iqr(D.trips(spark, sf).where(F.col("is_peak")))


@query
def iqr_offpeak(spark, sf):
    return _iqr(D.trips(spark, sf).where(~F.col("is_peak")))


@query
def iqr_entire_data(spark, sf):
    return _iqr(D.trips(spark, sf), ("user_type",))


@query
def iqr_age_group(spark, sf):
    return stats.iqr_with_outlier_pct(D.demo_trips(spark, sf), ["age_group"])


def _peak_trips(spark, sf, peak=True):
    return D.trips(spark, sf).where(F.col("is_peak") if peak else ~F.col("is_peak"))


@query
def outlier_flags(spark, sf):
    t = _peak_trips(spark, sf).select("year", "trip_id", "user_type", "duration_sec")
    return stats.flag_outliers(t, YEAR_USER)


@query
def outlier_share_peak(spark, sf):
    return stats.outlier_share(_peak_trips(spark, sf), YEAR_USER)


@query
def outlier_tails_peak(spark, sf):
    return stats.outlier_tails(_peak_trips(spark, sf), YEAR_USER)


@query
def outlier_tails_offpeak(spark, sf):
    return stats.outlier_tails(_peak_trips(spark, sf, peak=False), YEAR_USER)


@query
def duration_log_histogram(spark, sf):
    """30 log10 bins per user type; bins shared by the user types of one
    (year, peak/non-peak) panel."""
    t = D.trips(spark, sf).select("year", "is_peak", "user_type", "duration_sec")
    return stats.histogram(t, ["year", "is_peak", "user_type"], "duration_sec", K.DURATION_HIST_BINS,
                           scale_keys=["year", "is_peak"], log10=True)


# ------------------------------------------------------------------- routes
def _route_share(spark, sf):
    return routes.route_share(D.trips(spark, sf).select("year", "user_type", "route_id"), YEAR_USER)


def _route_sizes(spark, sf):
    return routes.route_sizes(D.trips(spark, sf).select("year", "user_type", "route_id"), YEAR_USER)


@query
def route_share(spark, sf):
    return _route_share(spark, sf)


@query
def route_share_stacked(spark, sf):
    """Both years' route tables stacked as the original did (no year column)."""
    return _route_share(spark, sf).drop("year")


@query
def route_share_iqr(spark, sf):
    return routes.route_share_iqr(_route_sizes(spark, sf), YEAR_USER)


@query
def route_share_histogram(spark, sf):
    """50 bins per (year, user type); rows with ``year`` NULL bin both years' routes stacked.

    The stacked copy is the same rows with ``year`` set to NULL, so one
    histogram pass (NULL is its own group) serves both views."""
    views = F.explode(F.array(F.col("year"), F.lit(None).cast("int")))
    return routes.route_share_histogram(_route_sizes(spark, sf).withColumn("year", views), YEAR_USER)


def _route_summary(spark, sf):
    return routes.route_summary(D.trips(spark, sf).select("user_type", "route_id"))


@query
def route_summary(spark, sf):
    return _route_summary(spark, sf)


@query
def route_ranked(spark, sf):
    return routes.route_ranked(_route_summary(spark, sf)).drop("cum_trips", "group_trips")


@query
def top10_routes(spark, sf):
    return routes.top_routes(_route_summary(spark, sf)).drop("cum_trips", "group_trips")


@query
def routes_for_50pct(spark, sf):
    return routes.routes_for_share(_route_summary(spark, sf))


@query
def top10_route_share(spark, sf):
    return routes.top_route_share(_route_summary(spark, sf))


@query
def route_kpi_summary(spark, sf):
    return routes.route_kpi_summary(_route_summary(spark, sf))


# ------------------------------------------------------------------- export
@query
def export_trip_2019(spark, sf):
    return D.legacy_trips(spark, sf)


@query
def export_trip_2020(spark, sf):
    return D.modern_trips(spark, sf)


@query
def bi_prepared_trips(spark, sf):
    return bi_prepare(D.trips(spark, sf))


@query
def export_route_ranked(spark, sf):
    return routes.route_ranked(_route_summary(spark, sf)).select("user_type", "route_rank", "cum_trip_pct")


@query
def export_trip_demo(spark, sf):
    return D.demo_trips(spark, sf).select("trip_id", "user_type", "age_group", "age_rank", "duration_sec",
                                          "duration_log10")


# Registry keys drop the ``_q`` suffix used where a name clashes with an import.
QUERIES = {k[:-2] if k.endswith("_q") else k: v for k, v in QUERIES.items()}
