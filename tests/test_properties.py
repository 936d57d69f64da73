"""Invariants of the analysis outputs on the sf0.01 tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_MID


@pytest.fixture(scope="module")
def q(spark):
    qs = E.queries()
    return lambda name: qs[name](spark, SF_MID)


def test_shares_total_one_per_group(q):
    for name, within, col, total in (
        ("round_trip_share", ["year", "user_type"], "pct_round_trip", 100.0),
        ("weekend_share", ["year", "user_type"], "pct", 1.0),
        ("age_user_mix", ["age_group"], "pct", 1.0),
        ("route_share", ["year", "user_type"], "pct", 100.0),
    ):
        sums = q(name).groupBy(*within).agg(F.sum(col).alias("s")).collect()
        assert sums and all(r.s == pytest.approx(total, rel=1e-9) for r in sums), name


def test_cumulative_route_share_is_monotone_and_ends_at_one(q):
    rows = q("route_ranked").select("user_type", "route_rank", "cum_trip_pct").collect()
    by = {}
    for r in rows:
        by.setdefault(r.user_type, []).append((r.route_rank, r.cum_trip_pct))
    for vals in by.values():
        vals.sort()
        assert [rk for rk, _ in vals] == list(range(1, len(vals) + 1))
        cums = [c for _, c in vals]
        assert all(a <= b for a, b in zip(cums, cums[1:])) and cums[-1] == 1.0


def test_tails_add_up_to_outliers(q):
    tails = {(r.year, r.user_type): (r.total, r.outlier_left + r.outlier_right)
             for r in q("outlier_tails_peak").collect()}
    share = {(r.year, r.user_type): (r.total, r.outliers) for r in q("outlier_share_peak").collect()}
    assert tails == share


def test_hour_threshold_has_every_hour_once_per_year(q):
    rows = q("hour_threshold").collect()
    years = {r.year for r in rows}
    assert len(rows) == 24 * len(years)
    for y in years:
        hours = sorted(r.start_hour for r in rows if r.year == y)
        assert hours == list(range(24))
        total = sum(r.n for r in rows if r.year == y)
        assert total == q("entire_data").where(F.col("year") == y).count()


def test_quartiles_are_ordered_and_fences_follow(q):
    for name in ("iqr_all", "iqr_peak", "iqr_offpeak", "iqr_entire_data", "iqr_age_group"):
        for r in q(name).collect():
            assert r.q1 <= r.med <= r.q3, name
            assert r.lower == pytest.approx(r.q1 - 1.5 * r.iqr) and r.upper == pytest.approx(r.q3 + 1.5 * r.iqr)


def test_histograms_count_every_row(q):
    h = q("duration_log_histogram").groupBy("year", "is_peak", "user_type").agg(F.sum("n").alias("n"))
    t = (q("entire_data").where(F.col("duration_sec") > 0)
         .groupBy("year", "is_peak", "user_type").agg(F.count(F.lit(1)).alias("n")))
    assert h.exceptAll(t).count() == 0 and t.exceptAll(h).count() == 0
    bins = q("duration_log_histogram").groupBy("year", "is_peak", "user_type").count()
    assert {r["count"] for r in bins.collect()} == {30}


def test_kpis_agree_with_the_ranked_table(q):
    kpi = {r.user_type: r for r in q("route_kpi_summary").collect()}
    r50 = {r.user_type: r.routes_for_50pct for r in q("routes_for_50pct").collect()}
    top = {r.user_type: r.pct_trip_top10 for r in q("top10_route_share").collect()}
    assert {k: v.routes_for_50pct for k, v in kpi.items()} == r50
    assert {k: v.pct_trip_top10 for k, v in kpi.items()} == pytest.approx(top)


def test_quality_report_agrees_with_single_checks(q):
    rep = {r.year: r for r in q("quality_report").collect()}
    assert rep[2019].missing_id_rows == q("missing_id_rows").first().missing_value
    assert rep[2019].constraint_violation == q("constraint_violations").first().constraint_violation
    assert rep[2020].missing_destination == q("missing_destination").count()
    inv = {r.year: r.inverted_times for r in q("inverted_times").collect()}
    assert {y: rep[y].inverted_times for y in rep} == inv
