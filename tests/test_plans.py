"""Physical-plan checks: the plans stay JVM-side, prune, push down, and use
the intended join strategy."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL


def _explain(df, mode: str) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def plan_of(df) -> str:
    return _explain(df, "simple")


def formatted(df) -> str:
    return _explain(df, "formatted")


from velostat.plans.catalog import QUERIES as OWN  # noqa: E402


@pytest.mark.parametrize("name", sorted(OWN))
def test_no_python_udf_in_any_plan(spark, name):
    p = plan_of(E.queries()[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in p


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


ONE_SCAN = ["outlier_share_peak", "outlier_tails_offpeak", "peak_share_trimmed", "duration_log_histogram",
            "route_share", "route_share_iqr", "route_share_histogram", "top10_routes", "route_kpi_summary",
            "hour_threshold"]


@pytest.mark.parametrize("name", ONE_SCAN)
def test_the_trips_are_scanned_once(spark, name):
    assert executed(E.queries()[name](spark, SF_SMALL)).count("FileScan parquet") == 1


@pytest.mark.parametrize("name", sorted(OWN))
def test_no_job_runs_and_nothing_is_written_before_the_result_is_asked_for(spark, name):
    import os

    from velostat.session import session_folder

    q = E.queries()[name]
    q(spark, SF_SMALL)  # curation, if not done yet
    sc = spark.sparkContext
    folder = session_folder(spark).replace("file:", "")
    before = sorted(os.listdir(folder))
    sc.setJobGroup(f"build-{name}", name)
    try:
        q(spark, SF_SMALL)
        assert list(sc.statusTracker().getJobIdsForGroup(f"build-{name}")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(os.listdir(folder)) == before


def test_curated_and_lazy_trips_have_one_schema_in_order(spark):
    from velostat.plans import datasets as D

    curated = D.trips(spark, SF_SMALL).dtypes
    spark.conf.set(D.MATERIALIZE_CONF, "false")
    try:
        assert D.trips(spark, SF_SMALL).dtypes == curated
    finally:
        spark.conf.unset(D.MATERIALIZE_CONF)


def test_no_cartesian_products_anywhere(spark):
    for name, q in OWN.items():
        p = plan_of(q(spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_peak_filter_and_columns_reach_the_scan(spark):
    f = formatted(E.queries()["iqr_peak"](spark, SF_SMALL))
    pushed = [ln for ln in f.splitlines() if ln.startswith("PushedFilters")]
    assert pushed and all("EqualTo(is_peak,true)" in ln for ln in pushed)
    read = {ln for ln in f.splitlines() if ln.startswith("ReadSchema")}
    assert read == {"ReadSchema: struct<user_type:string,duration_sec:bigint,is_peak:boolean>"}


def test_year_is_a_partition_column_of_the_curated_trips(spark):
    from pyspark.sql import functions as F

    from velostat.plans import datasets as D

    f = formatted(D.trips(spark, SF_SMALL).where(F.col("year") == 2020).select("trip_id"))
    assert "PartitionFilters: [isnotnull(year" in f


def test_quality_report_scans_each_source_once(spark):
    f = formatted(E.queries()["quality_report"](spark, SF_SMALL))
    scans = [ln for ln in f.splitlines() if ln.startswith("(") and "Scan parquet" in ln]
    assert len(scans) == 2  # curated legacy table + events


def test_top_routes_are_limited_per_task_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(E.queries()["top10_routes"](spark, SF_SMALL))


def test_route_ranking_is_split_below_the_user_type(spark):
    # ranks and running totals are per (group, range partition)
    p = plan_of(E.queries()["route_ranked"](spark, SF_SMALL))
    rn = p.split("row_number() windowspecdefinition(")[1].split(",")[:3]
    assert [c.strip().split("#")[0] for c in rn] == ["__g", "trip_count", "__p"]


def test_outlier_flags_broadcast_a_bounded_number_of_groups(spark):
    p = plan_of(E.queries()["outlier_flags"](spark, SF_SMALL))
    first = p.split("BroadcastExchange")[1].split("Exchange")[0]
    assert "TakeOrderedAndProject(limit=100000" in first and "octet_length" in first


def test_longest_trips_keep_every_row(spark):
    from velostat.plans import datasets as D

    df = E.queries()["longest_trips_legacy"](spark, SF_SMALL)
    assert "rangepartitioning" in plan_of(df) and "Limit" not in plan_of(df)
    lengths = [r.tripduration for r in df.collect()]
    assert len(lengths) == D.legacy_raw(spark, SF_SMALL).count()
    known = [x for x in lengths if x is not None]
    assert known == sorted(known, reverse=True) and lengths[: len(known)] == known


def test_curation_sorts_no_rows_and_opens_a_writer_for_each_year(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from velostat.plans import datasets as D
    from velostat.session import save_and_reload

    key, given = "spark.sql.maxConcurrentOutputFileWriters", []
    monkeypatch.setattr(D, "materialize", lambda df, name, partition_by=(): given.append((df, name, partition_by)) or df)
    D.reset_plans(spark)
    try:
        D.trips(spark, SF_SMALL)
    finally:
        D.reset_plans(spark)
    df, name, by = given[-1]
    assert "Sort [year" not in plan_of(df) and by == ("year",)
    before, held, write = spark.conf.get(key), [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, *a: held.append(int(spark.conf.get(key))) or write(w, *a))
    back = save_and_reload(df, name, by)
    assert held[0] >= 2 and spark.conf.get(key) == before  # else Spark sorts by partition before it writes
    assert back.columns == df.columns and back.groupBy("year").count().orderBy("year").collect() == df.groupBy("year").count().orderBy("year").collect()


def test_line_items_are_shuffled_once(spark):
    from velostat.sources.fixtures import legacy_source

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(legacy_source(spark, SF_SMALL)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = next(i for i, line in enumerate(plan) if "FileScan" in line and "l_orderkey" in line)
    depth, exchanges = len(plan[at]), 0
    for line in reversed(plan[: at + 1]):  # the nodes above the scan
        own = len(line) - len(line.lstrip(" :+-"))
        if own < depth:
            depth = own
            exchanges += "Exchange" in line
    assert exchanges == 1
