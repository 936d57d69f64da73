"""The analysis datasets, assembled lazily from the two sources.

``trips`` is the canonical, enriched trip table of both years stacked with a
``year`` column (the "entire data"): every per-year statistic is a group-by
on ``(year, …)`` over this one DataFrame instead of a loop over tables.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from velostat import constants as K
from velostat.operators.features import (
    enrich_trips,
    with_age_group,
    with_duration_log10,
    with_peak_flag,
)
from velostat.operators.normalize import (
    demographic_trips,
    normalize_legacy,
    normalize_modern,
    union_common,
    with_year,
)
from velostat.session import delete_session_folder, save_and_reload
from velostat.sources.fixtures import SPREAD_CONF, input_key, legacy_source, modern_source

MATERIALIZE_CONF = "velostat.materialize"
_PLANS: dict[tuple, DataFrame] = {}
_LISTED: dict[tuple[int, str], str] = {}


def materialize_enabled(spark: SparkSession) -> bool:
    return str(spark.conf.get(MATERIALIZE_CONF, "true")).lower() == "true"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once as parquet under the session's checkpoint folder and
    return a scan of it (no-op when ``velostat.materialize`` is ``false``).

    The folder is the shared one named by ``spark.checkpoint.dir`` (a scratch
    folder only when none is configured, i.e. in local runs).  Writing cuts
    the lineage — a lost executor costs a re-read, not a re-join — and later
    queries get a columnar scan with column pruning, filter pushdown and,
    with ``partition_by``, partition pruning.
    """
    if not materialize_enabled(df.sparkSession):
        return df
    return save_and_reload(df, name, partition_by)


def reset_plans(spark: SparkSession) -> None:
    """Forget the shared plans of ``spark``: the next use rebuilds (and
    re-curates) every dataset into fresh folders."""
    for key in [k for k in _PLANS if k[1] == id(spark)]:
        del _PLANS[key]


def drop_session_tables(spark: SparkSession) -> bool:
    """Forget the shared plans of ``spark`` and delete its curated and
    per-group tables from the checkpoint folder."""
    reset_plans(spark)
    return delete_session_folder(spark)


def shared_plan(fn):
    """Build a dataset's (lazy) DataFrame once per session, state of the input
    files and arguments, and hand the same plan to every query that uses it.

    With ``velostat.materialize`` on, the shared plan reads the curated copy
    written at first use.  The copies belong to the input files they were made
    from (:func:`velostat.sources.fixtures.input_key`): once a file is added,
    removed or rewritten, the next use curates anew.  Plans handed out before
    keep reading their own copy, which stays until :func:`drop_session_tables`.
    """

    @functools.wraps(fn)
    def wrapper(spark: SparkSession, sf_dir: str, *args):
        sf_dir = sf_dir.rstrip("/")
        # datasets built on others ask once, so that one plan holds one state of the files
        outer = _LISTED.get((id(spark), sf_dir))
        listed = _LISTED[id(spark), sf_dir] = outer or input_key(spark, sf_dir)
        try:
            key = (fn.__name__, id(spark), spark.conf.get(SPREAD_CONF, ""), materialize_enabled(spark), sf_dir, listed, args)
            df = _PLANS.get(key)
            if df is None or df.sparkSession is not spark:
                df = _PLANS[key] = fn(spark, sf_dir, *args)
            return df
        finally:
            if outer is None:
                del _LISTED[id(spark), sf_dir]

    return wrapper


@shared_plan
def legacy_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legacy source table (materialised: it is a three-way join)."""
    return materialize(legacy_source(spark, sf_dir), "legacy_source")


@shared_plan
def modern_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modern source table: a single scan and projection, left lazy."""
    return modern_source(spark, sf_dir)


@shared_plan
def legacy_trips(spark: SparkSession, sf_dir: str, population: str = "all") -> DataFrame:
    """Canonical, enriched legacy trips with ``year`` and ``is_peak``.

    ``population="demo"`` keeps only riders with gender and birth year (the
    population the original script ended up using for its 2019 figures).
    """
    df = normalize_legacy(legacy_raw(spark, sf_dir))
    if population == "demo":
        df = demographic_trips(df).drop("age")
    elif population != "all":
        raise ValueError(f"unknown population {population!r}")
    return with_peak_flag(enrich_trips(with_year(df, K.LEGACY_YEAR)))


@shared_plan
def modern_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical, enriched modern trips (valid trips only) with ``year``, ``is_peak``."""
    df = normalize_modern(modern_raw(spark, sf_dir))
    return with_peak_flag(enrich_trips(with_year(df, K.MODERN_YEAR)))


@shared_plan
def trips(spark: SparkSession, sf_dir: str, population: str = "all") -> DataFrame:
    """Both years stacked over their common columns (materialised, by year).

    The rows are written as they come.  Sorting each task's rows by hour, so
    that hour filters could skip row groups, held them as wide rows in memory
    (some ten times their Parquet bytes) and spilled them as the tables grew.
    """
    both = union_common(legacy_trips(spark, sf_dir, population), modern_trips(spark, sf_dir))
    return materialize(both, f"trips_{population}", ("year",))


@shared_plan
def demo_trips(spark: SparkSession, sf_dir: str, as_of_year: int = K.AS_OF_YEAR) -> DataFrame:
    """Legacy riders with demographics: ``age``, ``age_group``, ``age_rank``,
    ``duration_log10`` added to the enriched trips."""
    df = demographic_trips(normalize_legacy(legacy_raw(spark, sf_dir)), as_of_year)
    df = with_peak_flag(enrich_trips(df))
    return with_duration_log10(with_age_group(df))
