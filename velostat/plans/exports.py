"""The named tables published for the BI dashboard (export registry).

Names are the export file names of the original analysis (fixed values).
Each entry is a zero-argument builder, so ``write_exports`` constructs and
writes the tables one after another, in this (dependency) order.  A table that
several exports are cut from is computed once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velostat import constants as K
from velostat.operators.features import with_duration_log10
from velostat.plans import datasets as D
from velostat.plans.catalog import QUERIES


def bi_tables(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    q = {name: (lambda n=name: QUERIES[n](spark, sf_dir)) for name in QUERIES}
    ly, my = K.LEGACY_YEAR, K.MODERN_YEAR

    @functools.cache
    def once(name: str) -> DataFrame:
        return D.materialize(q[name](), name)

    def by(name: str, **eq) -> Callable[[], DataFrame]:
        def build() -> DataFrame:
            df = once(name)
            for c, v in eq.items():
                df = df.where(F.col(c) == v)
            return df
        return build

    # fixed values: export table names
    return {
        "trip_2019": lambda: D.legacy_trips(spark, sf_dir),
        "trip_2020": lambda: D.modern_trips(spark, sf_dir),
        "trip_2019_demo": q["export_trip_demo"],
        "entire_data": lambda: with_duration_log10(D.trips(spark, sf_dir)),
        "member_route_2019": by("route_share", year=ly, user_type="member"),
        "casual_route_2019": by("route_share", year=ly, user_type="casual"),
        "member_route_2020": by("route_share", year=my, user_type="member"),
        "casual_route_2020": by("route_share", year=my, user_type="casual"),
        "member_route": lambda: by("route_share", user_type="member")().drop("year"),
        "casual_route": lambda: by("route_share", user_type="casual")().drop("year"),
        "pct_vld_2019": by("outlier_share_peak", year=ly),
        "pct_vld_2020": by("outlier_share_peak", year=my),
        "route_ranked": q["export_route_ranked"],
        "kpi_summary": q["route_kpi_summary"],
        "iqr_entire_data": q["iqr_entire_data"],
    }
