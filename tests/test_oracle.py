"""Every registered query equals its SQL oracle (DuckDB) on the small tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from conftest import SF_SMALL  # noqa: E402
from oracle_check import _rows, type_mismatches  # noqa: E402

from velostat.plans.catalog import QUERIES as OWN  # noqa: E402

NAMES = sorted(OWN)


def test_every_query_has_an_oracle():
    assert set(E.oracle_sql()) >= set(OWN)
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    got = sdf.toPandas()
    rel = duck.sql(E.oracle_sql()[name])
    assert type_mismatches(sdf, {c: str(t) for c, t in zip(rel.columns, rel.types)}) == []
    want = rel.df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert len(got) == len(want)
    assert _rows(got, cols, 12) == _rows(want, cols, 12)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["year", "user_type", "total", "outliers", "pct"]
    assert df.count() > 0


def test_results_do_not_depend_on_session_time_zone(spark, duck):
    from velostat.plans import datasets as D

    names = ["entire_data", "trips_by_hour_weekday", "hour_threshold", "long_rentals", "bi_prepared_trips"]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
        D.reset_plans(spark)
        for name in names:
            got = E.queries()[name](spark, SF_SMALL).toPandas()
            want = duck.execute(E.oracle_sql()[name]).df()
            cols = sorted(got.columns)
            assert _rows(got, cols, 12) == _rows(want, cols, 12), name
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
        D.reset_plans(spark)
