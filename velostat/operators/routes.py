"""Route concentration: per-route shares, their spread, ranking and KPIs.

Everything here runs on route counts (one row per user type × route), never
on trips.  The KPIs and the spread need only the number of routes per trip
count: a group of N trips has at most sqrt(2N) distinct trip counts, so those
windows stay small.  The full ranking is split by trip count, and routes of one
trip count by ranges of route ids, so a user type holding most routes is ranked
by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velostat import constants as K
from velostat.functions import bisect_right
from velostat.operators.stats import (
    QUARTILES,
    _quantiles_of_counts,
    count_share,
    histogram,
    join_groups,
)

# routes of one group and trip count that are ranked in one range of route ids
RANK_RANGE = 4096
# about so many of them are looked at to place the bounds of more ranges
RANK_SAMPLE = 1024


def known_users(df: DataFrame, user_types: Sequence[str] | None) -> DataFrame:
    return df if user_types is None else df.where(F.col("user_type").isin(*user_types))


def route_share(
    df: DataFrame, keys: Sequence[str] = ("year", "user_type"),
    user_types: Sequence[str] | None = ("member", "casual"),
) -> DataFrame:
    """Trips per route and the route's percentage of its group's trips."""
    keys = list(keys)
    return count_share(known_users(df, user_types), keys + ["route_id"], keys, scale=100.0, name="pct", totals="join")


def route_sizes(
    df: DataFrame, keys: Sequence[str] = ("year", "user_type"),
    user_types: Sequence[str] | None = ("member", "casual"),
) -> DataFrame:
    """Routes per group and trip count: ``keys…, n, routes, pct``, where ``pct``
    is the percentage of the group's trips that one such route has."""
    keys = list(keys)
    counts = known_users(df, user_types).groupBy(*keys, "route_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("routes"))
    total = F.sum(F.col("n") * F.col("routes")).over(Window.partitionBy(*keys))
    return sizes.withColumn("pct", F.col("n").cast("double") / total.cast("double") * F.lit(100.0))


def route_share_iqr(sizes: DataFrame, keys: Sequence[str] = ("year", "user_type")) -> DataFrame:
    """Median, quartiles, IQR and maximum of the route percentage per group,
    from :func:`route_sizes`.

    Within a group every route share is ``n / total × 100`` with one total,
    so the quantiles are taken on the integer counts and scaled once.
    """
    keys = list(keys)
    counts = sizes.select(*keys, "n", F.col("routes").alias("__c"))
    q = _quantiles_of_counts(counts, keys, "n", *QUARTILES)
    tot = counts.groupBy(*keys).agg(F.sum(F.col("n") * F.col("__c")).alias("__t"), F.max("n").alias("__mx"))
    j = join_groups(q, tot, keys)

    def scaled(c):
        return F.col(c) / F.col("__t") * 100

    return j.select(
        *keys,
        scaled("med").alias("med"),
        scaled("q1").alias("q1"),
        scaled("q3").alias("q3"),
        (scaled("q3") - scaled("q1")).alias("iqr"),
        scaled("__mx").alias("max_route"),
    )


def route_share_histogram(
    sizes: DataFrame, keys: Sequence[str] = ("year", "user_type"), bins: int = K.ROUTE_HIST_BINS
) -> DataFrame:
    """Histogram of route percentages per group (each group its own bins)."""
    return histogram(sizes, keys, "pct", bins, weight="routes")


def route_summary(df: DataFrame, keys: Sequence[str] = ("user_type",)) -> DataFrame:
    return df.groupBy(*keys, "route_id").agg(F.count(F.lit(1)).alias("trip_count"))


def _ranked_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(
        *keys, "route_id", "trip_count", "route_rank",
        (F.col("trip_count") / F.col("group_trips")).alias("trip_pct"),
        (F.col("cum_trips") / F.col("group_trips")).alias("cum_trip_pct"),
        "cum_trips", "group_trips",
    )


def ranking_ranges(summary: DataFrame, keys: Sequence[str] = ("user_type",)) -> DataFrame:
    """Routes dealt to the parts in which they are ranked: ``__g`` (the group),
    ``trip_count`` and ``__p``, a range of route ids.

    Parts follow the ranking order: the trip count first, then the range.  Up
    to ``RANK_RANGE`` routes of one trip count are one range.  More are split
    at the ids of a sample, every k-th by hash with k such that about
    ``RANK_SAMPLE`` ids are taken however many there are.  The range of a
    route is an expression of its id and these bounds, so evaluating the plan
    again gives the same parts; nothing is written and no job runs here.
    ``__rb`` and ``__tb`` are the group's routes and trips of higher trip
    counts, ``group_trips`` all its trips.
    """
    keys = list(keys)
    grp = F.struct(*keys) if keys else F.struct(F.lit(0))
    rows = summary.select(grp.alias("__g"), "route_id", "trip_count")
    before = Window.partitionBy("__g").orderBy(F.col("trip_count").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    c, n = F.col("trip_count"), F.col("__n")
    steps = rows.groupBy("__g", "trip_count").agg(F.count(F.lit(1)).alias("__n")).select(
        "__g", "trip_count", "__n",
        (F.sum("__n").over(before) - n).alias("__rb"),
        (F.sum(c * n).over(before) - c * n).alias("__tb"),
        F.sum(c * n).over(Window.partitionBy("__g")).alias("group_trips"),
    )
    rows = rows.join(steps, ["__g", "trip_count"])
    every = F.ceil(n / F.lit(RANK_SAMPLE))
    sampled = rows.where((n > RANK_RANGE) & (F.pmod(F.xxhash64("route_id"), every) == 0))
    bounds = sampled.groupBy("__g", "trip_count").agg(F.sort_array(F.collect_list("route_id")).alias("__bounds"))
    # the sample is Poisson distributed around RANK_SAMPLE; its double is never reached
    part = F.coalesce(bisect_right("__bounds", "route_id", 2 * RANK_SAMPLE), F.lit(0))
    return rows.join(bounds, ["__g", "trip_count"], "left").withColumn("__p", part).drop("__bounds", "__n")


def route_ranked(summary: DataFrame, keys: Sequence[str] = ("user_type",)) -> DataFrame:
    """Rank routes by trip count (ties: route id ascending) within each group,
    with ``trip_pct`` and the cumulative share ``cum_trip_pct``.

    No task holds a whole group: the routes are dealt to the parts of
    :func:`ranking_ranges`, a small table of part sizes gives each part the
    routes ranked before it, and row numbers are local to a part.  All routes
    of a part have one trip count, so the running total follows from the rank.
    Counts are summed as integers and divided once, so ``cum_trip_pct``
    reaches exactly 1.
    """
    keys = list(keys)
    part = ["__g", "trip_count", "__p"]
    rows = ranking_ranges(summary, keys)
    before = Window.partitionBy("__g", "trip_count").orderBy("__p").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    sizes = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("__m")).select(
        *part, (F.sum("__m").over(before) - F.col("__m")).alias("__pb"))
    of_count = F.col("__pb") + F.row_number().over(Window.partitionBy(*part).orderBy("route_id"))
    ranked = rows.join(sizes, part).select(
        *[F.col("__g")[k].alias(k) for k in keys], "route_id", "trip_count", "group_trips",
        (F.col("__rb") + of_count).cast("int").alias("route_rank"),
        (F.col("__tb") + F.col("trip_count") * of_count).alias("cum_trips"),
    )
    return _ranked_columns(ranked, keys)


def top_routes(summary: DataFrame, keys: Sequence[str] = ("user_type",), k: int = K.TOP_ROUTES) -> DataFrame:
    """The ``k`` first routes per group of :func:`route_ranked`, straight from
    the counts: each task keeps its own ``k`` per group before the shuffle."""
    keys = list(keys)
    w = (Window.partitionBy(*keys).orderBy(F.col("trip_count").desc(), F.col("route_id").asc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    top = summary.select(
        *keys, "route_id", "trip_count",
        F.row_number().over(w).alias("route_rank"), F.sum("trip_count").over(w).alias("cum_trips"),
    ).where(F.col("route_rank") <= k)
    totals = summary.groupBy(*keys).agg(F.sum("trip_count").alias("group_trips"))
    return _ranked_columns(join_groups(top, totals, keys), keys)


def route_kpi_summary(summary: DataFrame, keys: Sequence[str] = ("user_type",), share: float = 0.5,
                      k: int = K.TOP_ROUTES) -> DataFrame:
    """Fewest top routes that together carry at least ``share`` of the group's
    trips, and the share of trips carried by its top ``k`` routes.

    Routes of equal trip count need no order for this: the steps run over the
    distinct trip counts of a group, largest first.
    """
    keys = list(keys)
    c, nr = F.col("trip_count"), F.col("__nr")
    sizes = summary.groupBy(*keys, "trip_count").agg(F.count(F.lit(1)).alias("__nr"))
    before = (Window.partitionBy(*keys).orderBy(c.desc())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = sizes.select(
        *keys, c, nr,
        (F.sum("__nr").over(before) - nr).alias("__rb"),
        (F.sum(c * nr).over(before) - c * nr).alias("__tb"),
        F.sum(c * nr).over(Window.partitionBy(*keys)).alias("__t"),
    )
    # the first whole number of trips that reaches the share
    missing = F.ceil(F.lit(float(share)) * F.col("__t").cast("double")).cast("bigint") - F.col("__tb")
    needed = F.greatest(F.lit(1).cast("bigint"), F.ceil(missing / F.greatest(c, F.lit(1))).cast("bigint"))
    of_top = F.greatest(F.lit(0).cast("bigint"), F.least(nr, F.lit(k) - F.col("__rb")))
    return steps.groupBy(*keys).agg(
        F.min(F.when(missing <= c * nr, F.col("__rb") + needed)).cast("int")
        .alias(f"routes_for_{int(round(share * 100))}pct"),
        (F.sum(c * of_top) / F.max("__t")).alias(f"pct_trip_top{k}"),
    )


def routes_for_share(summary: DataFrame, keys: Sequence[str] = ("user_type",), share: float = 0.5) -> DataFrame:
    """Fewest top routes that together carry at least ``share`` of the trips."""
    return route_kpi_summary(summary, keys, share).select(*keys, f"routes_for_{int(round(share * 100))}pct")


def top_route_share(summary: DataFrame, keys: Sequence[str] = ("user_type",), k: int = K.TOP_ROUTES) -> DataFrame:
    """Share of the group's trips carried by its top-``k`` routes."""
    return route_kpi_summary(summary, keys, k=k).select(*keys, f"pct_trip_top{k}")
