"""Hand-written edge rows for the value semantics the analysis depends on."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from velostat.functions import elapsed
from velostat.operators import features, normalize, profile, routes, stats

TS = dt.datetime


def trips_df(spark, rows):
    """Canonical trips from (trip_id, start, end, start_id, end_id, user_type)."""
    schema = ("trip_id string, start_time timestamp_ntz, end_time timestamp_ntz, start_station_id bigint, "
              "end_station_id bigint, user_type string")
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("duration_sec", elapsed("SECOND", "start_time", "end_time"))


def test_route_id_writes_missing_station_as_na(spark):
    df = features.enrich_trips(trips_df(spark, [
        ("a", TS(2019, 1, 1, 8), TS(2019, 1, 1, 9), 3, None, "member"),
        ("b", TS(2019, 1, 1, 8), TS(2019, 1, 1, 9), None, 7, "member"),
        ("c", TS(2019, 1, 1, 8), TS(2019, 1, 1, 9), 3, 3, "member"),
    ]))
    got = {r.trip_id: (r.route_id, r.round_trip) for r in df.collect()}
    assert got == {"a": ("3_NA", None), "b": ("NA_7", None), "c": ("3_3", True)}


def test_weekend_edges_and_week_starts_sunday(spark):
    df = features.enrich_trips(trips_df(spark, [
        ("fri", TS(2019, 1, 4, 23, 59, 59), TS(2019, 1, 5), 1, 2, "member"),
        ("sat", TS(2019, 1, 5, 23, 59, 59), TS(2019, 1, 6), 1, 2, "member"),
        ("sun", TS(2019, 1, 6, 0, 0, 0), TS(2019, 1, 6, 1), 1, 2, "member"),
        ("mon", TS(2019, 1, 7, 0, 0, 0), TS(2019, 1, 7, 1), 1, 2, "member"),
    ]))
    got = {r.trip_id: (r.weekday, r.weekday_num, r.is_weekend, r.start_hour) for r in df.collect()}
    assert got == {"fri": ("Fri", 6, False, 23), "sat": ("Sat", 7, True, 23),
                   "sun": ("Sun", 1, True, 0), "mon": ("Mon", 2, False, 0)}


def test_elapsed_truncates_like_a_warehouse_timestamp_diff(spark):
    df = trips_df(spark, [
        ("edge", TS(2019, 1, 1, 0, 0, 0, 900000), TS(2019, 1, 1, 0, 0, 1, 100000), 1, 1, "member"),
        ("zero", TS(2019, 1, 1), TS(2019, 1, 1), 1, 1, "member"),
        ("neg", TS(2019, 1, 1, 0, 1, 30), TS(2019, 1, 1), 1, 1, "member"),
    ])
    df = features.enrich_trips(df)
    got = {r.trip_id: (r.duration_sec, round(r.duration_min, 6)) for r in df.collect()}
    # 0.2 s across a second edge is 0 whole seconds; minutes are fractional
    assert got == {"edge": (0, round(0.2 / 60, 6)), "zero": (0, 0.0), "neg": (-90, -1.5)}


def test_recode_user_type_maps_unknown_and_null_to_null(spark):
    df = spark.createDataFrame([("Subscriber",), ("Customer",), ("Dependent",), (None,)], "user_type string")
    got = [r.user_type for r in normalize.recode_user_type(df).collect()]
    assert got == ["member", "casual", None, None]


def test_age_bins_are_left_closed_and_null_outside(spark):
    ages = [-1, 0, 17, 18, 64, 65, 119, 120, None]
    df = features.with_age_group(spark.createDataFrame([(a,) for a in ages], "age int"))
    got = [(r.age, r.age_group, r.age_rank) for r in df.collect()]
    assert got == [(-1, None, None), (0, "[0,18)", 1), (17, "[0,18)", 1), (18, "[18,25)", 2),
                   (64, "[55,65)", 6), (65, "[65,120)", 7), (119, "[65,120)", 7), (120, None, None),
                   (None, None, None)]


def test_coarse_bands_open_upper_end(spark):
    from velostat import constants as K

    df = features.with_age_group(spark.createDataFrame([(17,), (18,), (54,), (55,), (99,)], "age int"),
                                 K.AGE_BREAKS_COARSE)
    assert [r.age_group for r in df.collect()] == [None, "[18,25)", "[45,55)", "[55,Inf)", "[55,Inf)"]


def test_null_user_type_keeps_its_bounds_through_the_join(spark):
    rows = [(k, float(v)) for k, vals in (("member", [1, 2, 3, 4, 100]), (None, [10, 20, 30, 40, 50]))
            for v in vals]
    df = spark.createDataFrame(rows, "user_type string, duration_sec double")
    flagged = stats.flag_outliers(df, ["user_type"])
    null_rows = flagged.where(F.col("user_type").isNull()).collect()
    assert len(null_rows) == 5 and all(r.lower is not None for r in null_rows)
    share = {r.user_type: (r.total, r.outliers) for r in stats.outlier_share(df, ["user_type"]).collect()}
    assert share == {"member": (5, 1), None: (5, 0)}


def test_quantiles_type7_single_row_and_ties(spark):
    df = spark.createDataFrame([("one", 5.0), ("tie", 2.0), ("tie", 2.0), ("tie", 2.0), ("tie", 9.0)],
                               "g string, v double")
    for method in ("counts", "builtin"):
        q = {r.g: (r.q1, r.med, r.q3) for r in stats.quantiles(df, ["g"], "v", method=method).collect()}
        assert q["one"] == (5.0, 5.0, 5.0)
        assert q["tie"] == tuple(float(x) for x in np.percentile([2, 2, 2, 9], [25, 50, 75]))


def test_quantiles_match_numpy_on_random_groups(spark):
    rng = np.random.default_rng(7)
    rows = [(f"g{g}", int(x)) for g in range(4) for x in rng.integers(0, 50 + g * 500, size=20 + g * 37)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    got = {r.g: (r.q1, r.med, r.q3) for r in stats.quantiles(df, ["g"], "v").collect()}
    for g in got:
        vals = [v for k, v in rows if k == g]
        want = tuple(float(x) for x in np.percentile(vals, [25, 50, 75]))
        assert got[g] == pytest.approx(want, rel=1e-12)


def test_quantiles_ignore_nulls_and_all_null_group(spark):
    df = spark.createDataFrame([("a", None), ("a", 4), ("b", None)], "g string, v bigint")
    got = {r.g: r.med for r in stats.quantiles(df, ["g"], "v").collect()}
    assert got == {"a": 4.0}  # a group with no values has no value rows to rank


def test_hour_threshold_fills_empty_hours_and_orders_ties(spark):
    rows = [(2019, h) for h in (8, 8, 8, 17, 17, 17, 5)]
    df = spark.createDataFrame(rows, "year int, start_hour int")
    out = profile.hour_threshold(df, ["year"]).orderBy("hour_rank").collect()
    assert len(out) == 24
    assert [(r.start_hour, r.n) for r in out[:4]] == [(8, 3), (17, 3), (5, 1), (0, 0)]
    assert out[0].pct_to_max == 100.0 and out[0].delta_to_above == 0.0
    assert out[1].delta_to_above == 0.0 and out[2].pct_to_max == pytest.approx(33.33)
    # after a zero count the change to the row above is undefined
    assert out[4].delta_to_above is None


def test_share_within_zero_total_and_group_of_one(spark):
    counts = spark.createDataFrame([("a", "x", 0), ("a", "y", 0), ("b", "x", 3)], "g string, k string, n bigint")
    got = {(r.g, r.k): r.pct for r in stats.share_within(counts, ["g"]).collect()}
    assert got[("b", "x")] == 1.0
    assert got[("a", "x")] is None and got[("a", "y")] is None


def test_route_rank_ties_break_on_route_id(spark):
    rows = [("member", "2_2")] * 3 + [("member", "1_1")] * 3 + [("member", "3_3")] * 1
    df = spark.createDataFrame(rows, "user_type string, route_id string")
    ranked = routes.route_ranked(routes.route_summary(df)).orderBy("route_rank").collect()
    assert [(r.route_id, r.route_rank) for r in ranked] == [("1_1", 1), ("2_2", 2), ("3_3", 3)]
    assert [r.cum_trip_pct for r in ranked][-1] == 1.0
    kpi = routes.route_kpi_summary(routes.route_summary(df)).collect()[0]
    assert kpi.routes_for_50pct == 2 and kpi.pct_trip_top10 == 1.0


def test_union_casts_ids_before_stacking(spark):
    a = normalize.with_year(spark.createDataFrame([(123, "x")], "trip_id bigint, c string"), 2019)
    b = normalize.with_year(spark.createDataFrame([("157EAA4C", 1.0)], "trip_id string, d double"), 2020)
    out = normalize.union_common(a, b)
    assert out.columns == ["trip_id", "year"]
    assert sorted(r.trip_id for r in out.collect()) == ["123", "157EAA4C"]


def test_histogram_edges_centre_first_and_last_bins(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (0, 1, 2, 3, 4, 10)], "g string, v double")
    h = stats.histogram(df, ["g"], "v", bins=11).orderBy("bin").collect()
    assert len(h) == 11 and sum(r.n for r in h) == 6
    assert h[0].bin_lo == pytest.approx(-0.5) and h[-1].bin_hi == pytest.approx(10.5)
    assert [r.n for r in h][:5] == [1, 1, 1, 1, 1] and h[-1].n == 1


def test_log_histogram_skips_non_positive(spark):
    df = spark.createDataFrame([("a", v) for v in (0, -5, 1, 10, 100)], "g string, v bigint")
    h = stats.histogram(df, ["g"], "v", bins=3, log10=True).orderBy("bin").collect()
    assert [r.n for r in h] == [1, 1, 1]


def test_constant_columns_counts_null_as_a_value(spark):
    from velostat.operators import quality

    df = spark.createDataFrame([("k", None, 1), ("k", None, 2)], "a string, b string, c int")
    got = {r.column_name: r.is_constant for r in quality.constant_columns(df).collect()}
    assert got == {"a": True, "b": True, "c": False}


def test_unknown_hours_stay_unknown(spark):
    from velostat.functions import columns
    from velostat.operators import stats

    hours = spark.createDataFrame([(8,), (None,), (12,)], "h int")
    peak = lambda c: columns.in_hour_windows(c, [(7, 9)])
    assert [r.p for r in hours.select(peak("h").alias("p")).collect()] == [True, None, False]
    counts = spark.createDataFrame([("a", 1, 5), ("a", None, 2)], "g string, h int, n long")
    out = stats.densify(counts, ["g"], "h", 0, 2, {"n": 0})
    assert sorted(((r.h, r.n) for r in out.collect()), key=str) == [(0, 0), (1, 5), (2, 0), (None, 2)]


def test_longest_orders_all_rows_with_deterministic_ties(spark):
    from velostat.operators import quality

    df = spark.createDataFrame([(5, "b"), (5, "a"), (9, "z"), (1, "q")], "d int, name string")
    out = [(r.d, r.name) for r in quality.longest(df, "d", "d", ["name"]).collect()]
    assert out == [(9, "z"), (5, "a"), (5, "b"), (1, "q")]


def test_bucketed_quantiles_match_numpy_with_many_buckets(spark):
    rng = np.random.default_rng(11)
    rows = [(g, int(x)) for g in ("a", None, "c") for x in rng.integers(-300, 900, size=257)]
    rows.append(("single", 5))
    df = spark.createDataFrame(rows, "g string, v bigint")
    bucketed = {r.g: (r.q1, r.med, r.q3) for r in stats.quantiles(df, ["g"], "v", bucket_width=7).collect()}
    single = {r.g: (r.q1, r.med, r.q3) for r in stats.quantiles(df, ["g"], "v", bucket_width=None).collect()}
    assert bucketed == single
    for g in ("a", None, "c", "single"):
        vals = [v for k, v in rows if k == g]
        assert bucketed[g] == pytest.approx(tuple(float(x) for x in np.percentile(vals, [25, 50, 75])), rel=1e-12)


def test_approx_quantiles_stay_within_rank_error(spark):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 100_000, size=5000)
    df = spark.createDataFrame([("g", int(v)) for v in vals], "g string, v bigint")
    got = stats.quantiles(df, ["g"], "v", method="approx").collect()[0]
    srt = np.sort(vals)
    n = len(vals)
    for p, q in ((0.25, got.q1), (0.5, got.med), (0.75, got.q3)):
        rank = np.searchsorted(srt, q, side="left")
        assert abs(rank - p * (n - 1)) <= n / stats.APPROX_ACCURACY + 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_split_route_ranking_matches_a_plain_sort(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for user in ("member", "casual", None):
        ids = {f"{rng.integers(1, 120)}_{rng.integers(1, 120)}" for _ in range(400)}
        for rid in sorted(ids):
            rows.append((user, rid, int(rng.choice([1, 1, 1, 2, 2, 3, 5, 40]))))
    summary = spark.createDataFrame(rows, "user_type string, route_id string, trip_count bigint")
    ranked = {(r.user_type, r.route_id): (r.route_rank, r.cum_trips, r.group_trips)
              for r in routes.route_ranked(summary).collect()}
    want, need, top = {}, {}, {}
    for user in ("member", "casual", None):
        grp = sorted([(c, rid) for u, rid, c in rows if u == user], key=lambda t: (-t[0], t[1]))
        total, cum = sum(c for c, _ in grp), 0
        for rank, (c, rid) in enumerate(grp, start=1):
            cum += c
            want[(user, rid)] = (rank, cum, total)
            if cum >= 0.5 * total:
                need.setdefault(user, rank)
        top[user] = sum(c for c, _ in grp[:10]) / total
    assert ranked == want
    got = {(r.user_type, r.route_id): (r.route_rank, r.cum_trips, r.group_trips)
           for r in routes.top_routes(summary).collect()}
    assert got == {k: v for k, v in want.items() if v[0] <= 10}
    kpi = routes.route_kpi_summary(summary).collect()
    assert {r.user_type: r.routes_for_50pct for r in kpi} == need
    assert {r.user_type: r.pct_trip_top10 for r in kpi} == top


def test_route_ranking_splits_many_routes_of_one_prefix_and_count(spark):
    # the cluster default of AQE would merge these small partitions again
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        summary = spark.range(120_000).select(
            F.when(F.col("id") >= 0, "member").alias("user_type"), F.format_string("NA_%06d", "id").alias("route_id"),
            F.when(F.col("id") >= 0, 1).cast("bigint").alias("trip_count"))
        ranked = routes.route_ranked(summary)
        wrong = ranked.where(F.col("route_rank") != F.substring("route_id", 4, 6).cast("int") + 1)
        assert ranked.count() == 120_000 and wrong.count() == 0
        sizes = [r["count"] for r in routes.ranking_ranges(summary).groupBy("__p").count().collect()]
        assert len(sizes) > 100 and max(sizes) < 120_000 / 50
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_outlier_counts_skip_null_values_and_null_groups(spark):
    vals = [1, 2, 3, 4, 100, None]
    df = spark.createDataFrame([("a", v) for v in vals] + [("b", None), (None, 7)], "g string, v bigint")
    got = {r.g: r for r in stats.outlier_summary(df, ["g"], "v").collect()}
    assert {g: (r.total, r.known, r.outlier_left, r.outlier_right) for g, r in got.items()} == {
        "a": (6, 5, 0, 1), "b": (1, 0, 0, 0), None: (1, 1, 0, 0)}
    assert got["a"].med == 3.0 and got["b"].med is None and got[None].upper == 7.0
    pct = {r.g: r.outlier_pct for r in stats.iqr_with_outlier_pct(df, ["g"], "v").collect()}
    assert pct == {"a": 20.0, "b": None, None: 0.0}


def test_null_start_times_keep_their_row_and_no_peak_flag(spark):
    df = features.enrich_trips(trips_df(spark, [
        ("a", TS(2019, 1, 1, 8), TS(2019, 1, 1, 9), 1, 2, "member"),
        ("b", None, TS(2019, 1, 1, 9), 1, 2, "member"),
    ])).withColumn("year", F.lit(2019))
    df = features.with_peak_flag(df)
    out = {r.start_hour: r.n for r in profile.hour_threshold(df, ["year"]).collect()}
    assert len(out) == 25 and out[8] == 1 and out[None] == 1
    share = profile.peak_share(df).collect()[0]
    assert (share.n_peak, share.n_total) == (1, 2)
    assert df.where(~F.col("is_peak")).count() == 0


def test_range_bucketed_quantiles_for_doubles(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(x)) for g in ("a", None) for x in rng.lognormal(3, 2, size=300)]
    rows += [("const", 2.5), ("const", 2.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    bucketed = {r.g: (r.q1, r.med, r.q3) for r in stats.quantiles(df, ["g"], "v").collect()}
    single = {r.g: (r.q1, r.med, r.q3) for r in stats.quantiles(df, ["g"], "v", bucket_width=None).collect()}
    builtin = {r.g: (r.q1, r.med, r.q3) for r in stats.quantiles(df, ["g"], "v", method="builtin").collect()}
    assert bucketed == single
    for g in ("a", None, "const"):
        vals = [v for k, v in rows if k == g]
        want = tuple(float(x) for x in np.percentile(vals, [25, 50, 75]))
        assert bucketed[g] == pytest.approx(want, rel=1e-12) and builtin[g] == pytest.approx(want, rel=1e-12)


def test_one_outlier_leaves_the_value_buckets_small(spark):
    rng = np.random.default_rng(8)
    vals = [*rng.normal(0, 1, size=20_000).tolist(), 1e12, -1e300, 0.0, -0.0]
    df = spark.createDataFrame([(1, float(v)) for v in vals] + [(None, 4.5), (2, None)], "g int, v double")
    counts = stats.value_counts(df, ["g"], "v")
    sc = spark.sparkContext
    sc.setJobGroup("build-quantiles", "quantiles")
    try:
        out = stats.quantiles(df, ["g"], "v")
        ranked = stats._ranks_bucketed(counts, ["g"], "v", None)
        assert list(sc.statusTracker().getJobIdsForGroup("build-quantiles")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    got = {r.g: (r.q1, r.med, r.q3) for r in out.collect()}
    assert got[1] == pytest.approx(tuple(np.percentile(vals, [25, 50, 75])), rel=1e-12)
    assert got[None] == (4.5, 4.5, 4.5) and 2 not in got
    # the window of the running count is partitioned by the bucket: measure its partitions
    buckets = ranked.select(F.expr("__hi - __c").alias("lo"), "__n").where("__n > 1000").count()
    assert buckets == counts.where("g = 1").count()
    window = ranked._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(__g" in window and "__bk" in window
    sizes = _bucket_sizes(counts)
    assert sum(sizes) == buckets and max(sizes) < buckets / 100


def _bucket_sizes(counts):
    from velostat.functions import bisect_right

    of_group = counts.where("g = 1")
    probs = [i / stats.RANGE_BUCKETS for i in range(1, stats.RANGE_BUCKETS)]
    bounds = of_group.agg(F.percentile_approx("v", probs, stats.BOUNDS_ACCURACY).alias("b")).first().b
    part = bisect_right(F.array(*map(F.lit, bounds)), "v", stats.RANGE_BUCKETS)
    return [r["count"] for r in of_group.groupBy(part.alias("p")).count().collect()]


@pytest.mark.parametrize("kind", ["double", "float", "decimal(12,3)"])
def test_quantiles_of_non_integral_types(spark, kind):
    rng = np.random.default_rng(1)
    vals = np.round(rng.exponential(50, size=500), 3)
    df = spark.createDataFrame([("a", float(v)) for v in vals], "g string, v double").withColumn("v", F.col("v").cast(kind))
    got = stats.quantiles(df, ["g"], "v").collect()[0]
    want = np.percentile(vals.astype(np.float32).astype(float) if kind == "float" else vals, [25, 50, 75])
    assert (got.q1, got.med, got.q3) == pytest.approx(tuple(want), rel=1e-9)


def test_bisection_counts_edges_below(spark):
    from velostat.functions import bisect_left, bisect_right

    rows = [(e, x) for e in ([], [1.0], [1.0, 2.0, 2.0, 5.0], list(map(float, range(40)))) for x in (-1.0, 1.0, 2.0, 3.5, 39.0, 99.0, None)]
    df = spark.createDataFrame([*rows, (None, 1.0)], "e array<double>, x double")
    out = df.select("e", "x", bisect_left("e", "x", 40).alias("l"), bisect_right("e", "x", 40).alias("r")).collect()
    for r in out:
        if r.e is None or r.e and r.x is None:
            assert (r.l, r.r) == (None, None)
        else:
            assert (r.l, r.r) == (int(np.searchsorted(r.e, r.x or 0, "left")) if r.e else 0, int(np.searchsorted(r.e, r.x or 0, "right")) if r.e else 0)


@pytest.mark.parametrize("limit", [None, 2, 0])
def test_group_tables_join_the_same_whatever_is_broadcast(spark, limit):
    rows = [(k, n, i) for i, (k, n) in enumerate([("a", 1), ("b", None), (None, 1), (None, None), ("c", 2), ("wide" * 300, 1), ("a", 1), ("gone", 9)])]
    df = spark.createDataFrame(rows, "k string, n int, i int")
    table = df.where("k IS NULL OR k <> 'gone'").groupBy("k", "n").agg(F.min("i").alias("least"))
    got = stats.join_group_table(df, table, ["k", "n"], limit)
    assert got.columns == ["k", "n", "i", "least"]
    assert sorted((r.i, r.least) for r in got.where("least IS NOT NULL").collect()) == [(i, 0 if i == 6 else i) for i in range(7)]
    assert [r.i for r in got.where("least IS NULL").collect()] == [7]


@pytest.mark.parametrize("log10", [False, True])
def test_bin_bounds_hold_for_values_on_the_edges(spark, log10):
    import math

    rng = np.random.default_rng(4)
    for bins, lo, hi in ((7, 0.1, 0.7), (30, 1.0, 1e6), (50, 3.0, 3.0000001)):
        to = math.log10 if log10 else float
        w = (to(hi) - to(lo)) / (bins - 1)
        edges = [to(lo) - w / 2 + i * w for i in range(1, bins)]
        edges = [10**e for e in edges] if log10 else edges
        near = [f(e) for e in edges for f in (lambda e: e, lambda e: np.nextafter(e, 0), lambda e: np.nextafter(e, 1e9))]
        vals = [lo, hi, *[float(v) for v in near if lo <= v <= hi], *rng.uniform(lo, hi, 50).tolist()]
        df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
        h = stats.histogram(df, ["g"], "v", bins, log10=log10).orderBy("bin").collect()
        xs = [r.x for r in df.select((F.log10("v") if log10 else F.col("v")).alias("x")).collect()]
        assert [r.n for r in h] == [sum(r.bin_lo < x <= r.bin_hi for x in xs) for r in h] and sum(r.n for r in h) == len(xs)


def curve(spark, years):
    """Rows of hour_threshold from ranked (pct_to_max, delta_to_above)."""
    rows = [(y, rank, 23 - rank, float(p), d) for y, steps in years.items() for rank, (p, d) in enumerate(steps, start=1)]
    return spark.createDataFrame(rows, "year int, hour_rank int, start_hour int, pct_to_max double, delta_to_above double")


def test_the_break_point_is_the_first_run_of_flat_steps(spark):
    df = curve(spark, {
        1: [(100, 0.0), (99, 1.0), (60, 39.0), (59.5, 0.8), (59, 0.8), (58.9, 0.2), (20, 66.0), (19.9, 0.5), (19.8, 0.5)],
        2: [(100, 0.0), (50, 50.0), (49.9, 0.2), (10, 80.0)],       # one flat step is no run
        3: [(100, 0.0), (99.5, 0.5), (99.4, 0.1)],                   # flat from the second rank on
        4: [(100, 0.0), (0, 100.0), (0, None), (0, None)],           # no step from zero to zero
    })
    got = {r.year: (r.break_rank, r.break_hour, r.detected_cutoff, r.flat_steps) for r in profile.peak_cutoff(df).collect()}
    assert got == {1: (4, 19, 59.5, 3), 2: (None, None, None, 0), 3: (2, 21, 99.5, 2), 4: (None, None, None, 0)}
    one = {r.year: r.detected_cutoff for r in profile.peak_cutoff(df, run=1).collect()}
    assert one == {1: 99.0, 2: 49.9, 3: 99.5, 4: None}
    peaks = profile.peak_hours_by_curve(df).collect()
    assert sorted((r.year, r.hour_rank) for r in peaks) == [(1, 1), (1, 2), (1, 3), (1, 4), (3, 1), (3, 2)]
    assert {r.detected_cutoff for r in peaks if r.year == 1} == {59.5}


def test_the_fixed_cutoff_is_the_break_point_of_such_a_curve(spark):
    steps = [(100, 0.0), (80, 20.0), (60, 25.0), (40, 33.3), (36.2, 9.5), (35.55, 1.8), (35, 1.5), (20, 42.9)]
    assert profile.peak_cutoff(curve(spark, {2019: steps})).first().detected_cutoff == 35.55


def test_union_refuses_types_that_differ_without_a_rule(spark):
    a = spark.createDataFrame([(1, 2.5)], "id int, x float")
    b = spark.createDataFrame([("r1", 3.5)], "id string, x double")
    with pytest.raises(TypeError, match="'id'.*int.*string"):
        normalize.union_common(a, b)
    out = normalize.union_common(a, b, types={"id": "string"})
    assert out.dtypes == [("id", "string"), ("x", "double")]
    assert sorted(tuple(r) for r in out.collect()) == [("1", 2.5), ("r1", 3.5)]
    with pytest.raises(ValueError, match="gone"):
        normalize.union_common(a, b, types={"id": "string", "gone": "int"})


def test_union_widens_whole_numbers_and_floats_only(spark):
    a = spark.createDataFrame([(1, "x", 1)], "n smallint, s string, only int")
    b = spark.createDataFrame([(2**40, "y")], "n bigint, s string")
    assert normalize.union_common(a, b).dtypes == [("n", "bigint"), ("s", "string")]
    c = a.select(F.col("n").cast("decimal(10,0)").alias("n"), "s")
    with pytest.raises(TypeError, match="'n'"):
        normalize.union_common(a, c)
    d = spark.sql("SELECT DATE'2020-01-01' AS t"), spark.sql("SELECT TIMESTAMP_NTZ'2020-01-01 00:00:00' AS t")
    with pytest.raises(TypeError, match="'t'"):
        normalize.union_common(*d)
