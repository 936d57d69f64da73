"""Grouped statistics: exact quantiles, IQR fences, outlier flags, shares,
key-domain densification and histograms.

Scale notes
-----------
* Exact quantiles default to a *value-count* plan: ``groupBy(keys, value)``
  counts (map-side combined, spread over all reducers by ``(keys, value)``),
  then a running count ordered by value.  The running count is split into
  value buckets whose rank offsets come from a small table of bucket totals.
  For integral values a bucket is ``QUANTILE_BUCKET_WIDTH`` wide; for others
  its bounds are quantiles of the group's distinct values, so a bucket holds
  about one in ``RANGE_BUCKETS`` of these wherever they lie.  However large or
  skewed a group is, no window partition holds all of it.  The built-in
  ``percentile`` (``method="builtin"``) is also exact but merges every partial
  value map of a group in one final task.
* Outlier counts and histograms also start from value counts, so the rows are
  scanned once and only distinct values meet the fences or ranges.
* Only :func:`flag_outliers` joins fences to rows.  The join broadcasts at
  most ``BROADCAST_MAX_ROWS`` groups of at most ``BROADCAST_ROW_BYTES`` each,
  and joins the rows of any other group by the size AQE measures.
* Nothing here runs a job or writes a file while a plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velostat import constants as K
from velostat.functions import bisect_left, bisect_right

_QUANTILE_NAMES = {0.25: "q1", 0.5: "med", 0.75: "q3"}
QUARTILES = ((0.25, 0.5, 0.75), ("q1", "med", "q3"))
# distinct integral values per window partition in the bucketed running count
QUANTILE_BUCKET_WIDTH = 4096
# buckets of a group's distinct non-integral values in the bucketed running count
RANGE_BUCKETS = 1024
# accuracy of the sketch that places their bounds (rank error <= distinct values / accuracy)
BOUNDS_ACCURACY = 10_000
# accuracy of the approximate quantile sketch (rank error <= n / accuracy)
APPROX_ACCURACY = 10_000
# most groups, and most bytes of each (as JSON), of a per-group table that are broadcast to the row-level side
BROADCAST_MAX_ROWS = 100_000
BROADCAST_ROW_BYTES = 512


def _keys(keys: Sequence[str] | str | None) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def null_safe_join_cond(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column | None:
    cond = None
    for lk, rk in pairs:
        c = left[lk].eqNullSafe(right[rk])
        cond = c if cond is None else (cond & c)
    return cond


def join_group_table(
    df: DataFrame, table: DataFrame, keys: Sequence[str], max_broadcast_rows: int | None = None,
) -> DataFrame:
    """Left-join a per-group table (one row per group) onto rows by ``keys``,
    NULL matching NULL.

    Two plans in one, chosen row by row when the query runs.  The first
    ``max_broadcast_rows`` groups in key order (default
    ``BROADCAST_MAX_ROWS``), as far as a group has at most
    ``BROADCAST_ROW_BYTES`` bytes, are broadcast: a proven bound, and rows of
    these groups are never shuffled.  Rows of all other groups are joined
    without a hint, so AQE decides by the sizes it measures and splits skewed
    groups.  Usually there are none, and that branch moves nothing.  ``df`` is
    read by both branches and has to give the same rows to both.
    """
    keys = _keys(keys)
    if not keys:
        raise ValueError("join_group_table needs at least one key")
    limit = BROADCAST_MAX_ROWS if max_broadcast_rows is None else max_broadcast_rows
    ren = {k: f"__g_{k}" for k in keys}
    t = table.withColumnsRenamed(ren)
    added = [c for c in t.columns if c not in ren.values()]
    narrow = F.octet_length(F.to_json(F.struct(*map(_quote, t.columns)))) <= BROADCAST_ROW_BYTES
    first = t.where(narrow).orderBy(*ren.values()).limit(limit).withColumn("__hit", F.lit(True))
    cond = [F.col(_quote(k)).eqNullSafe(F.col(_quote(r))) for k, r in ren.items()]
    met = df.join(F.broadcast(first), cond, "left")
    done = met.where("__hit").select(*map(_quote, df.columns + added))
    rest = met.where("__hit IS NULL").select(*map(_quote, df.columns))
    return done.unionByName(rest.join(t, cond, "left").select(*done.columns))


def join_groups(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join a per-group table ``b`` onto an aggregated table ``a`` by
    ``keys``, NULL matching NULL.  Lazy and without a hint: a small ``b`` is
    broadcast by Catalyst or, from its measured size, by AQE."""
    keys = _keys(keys)
    if not keys:
        raise ValueError("join_groups needs at least one key")
    ren = {k: f"__j_{k}" for k in keys}
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(ren[k]))
        cond = c if cond is None else (cond & c)
    return a.join(b.withColumnsRenamed(ren), cond, "left").drop(*ren.values())


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per ``(keys, value)`` as ``__c``; NULL values are counted too.

    Fences, outlier counts and histograms all start from this one aggregate.
    They use it unfiltered and with the same columns, so its shuffle is
    computed once and reused, and the trips are scanned once."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))


# ---------------------------------------------------------------- quantiles
def quantiles(
    df: DataFrame,
    keys: Sequence[str] | str | None,
    value: str,
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    names: Sequence[str] | None = None,
    method: str = "counts",
    bucket_width: int | None = QUANTILE_BUCKET_WIDTH,
) -> DataFrame:
    """Exact type-7 (linear interpolation) quantiles of ``value`` per group.

    NULL values are ignored; a group with no non-NULL value has no row.
    ``method="counts"`` (default) plans value counts + a running count split
    into value buckets: ``bucket_width`` wide for an integral ``value``,
    ``RANGE_BUCKETS`` buckets of about equally many distinct values otherwise
    (``bucket_width=None``: one running count per group).
    ``method="builtin"`` uses Spark's ``percentile`` aggregate;
    ``method="approx"`` a bounded-memory sketch (``percentile_approx``) whose
    results are data values within a rank error of ``n / APPROX_ACCURACY``.
    """
    keys = _keys(keys)
    names = list(names) if names else [_QUANTILE_NAMES.get(p, f"p{int(p * 100)}") for p in probs]
    if method == "builtin":
        arr = F.percentile(F.col(value), F.array(*[F.lit(float(p)) for p in probs]))
        out = df.groupBy(*keys).agg(arr.alias("__q"))
        return out.select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])
    if method == "approx":
        # Greenwald-Khanna sketch per group: a returned value's rank is within
        # n / APPROX_ACCURACY of the exact rank (not interpolated).
        arr = F.percentile_approx(F.col(value), [float(p) for p in probs], APPROX_ACCURACY)
        out = df.groupBy(*keys).agg(arr.alias("__q"))
        return out.select(*keys, *[F.col("__q")[i].cast("double").alias(n) for i, n in enumerate(names)])
    if method != "counts":
        raise ValueError(f"unknown quantile method {method!r}")

    counts = value_counts(df.where(F.col(value).isNotNull()), keys, value)
    return _quantiles_of_counts(counts, keys, value, probs, names, bucket_width)


def _quantiles_of_counts(
    counts: DataFrame, keys: list[str], value: str, probs: Sequence[float], names: Sequence[str],
    bucket_width: int | None = QUANTILE_BUCKET_WIDTH,
) -> DataFrame:
    """Quantiles from rows ``(keys, value, __c)``.  A value may be spread over
    several rows; a NULL value has no rank."""
    # Built from SQL expression text: the same plan as Column objects, but one
    # JVM call per expression instead of one per node.
    q = _quote
    vq = q(value)
    integral = isinstance(counts.schema[value].dataType, T.IntegralType)
    if bucket_width:
        ranked = _ranks_bucketed(counts, keys, value, bucket_width if integral else None)
    else:
        part = f"PARTITION BY {', '.join(q(k) for k in keys)}" if keys else ""
        ranked = counts.where(F.col(value).isNotNull()).selectExpr(
            *[q(k) for k in keys], vq, "__c",
            f"sum(__c) OVER ({part} ORDER BY {vq} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __hi",
            f"sum(__c) OVER ({part}) AS __n",
        )
    # a distinct value covers the 0-based ranks [__hi - __c, __hi)
    aggs = [F.expr("max(__n)").alias("__n")]
    for i, p in enumerate(probs):
        pos = f"({float(p)!r}D * CAST(__n - 1 AS DOUBLE))"
        for side, fn in (("l", "floor"), ("h", "ceil")):
            rank = f"{fn}{pos}"
            aggs.append(F.expr(f"max(CASE WHEN __hi - __c <= {rank} AND {rank} < __hi THEN {vq} END)")
                        .alias(f"__{side}{i}"))
    picked = ranked.groupBy(*keys).agg(*aggs)
    if keys:
        picked = picked.where("__n > 0")  # a group of NULL values only has no quantiles
    cols = []
    for i, (p, n) in enumerate(zip(probs, names)):
        pos = f"({float(p)!r}D * CAST(__n - 1 AS DOUBLE))"
        lo, hi = f"CAST(__l{i} AS DOUBLE)", f"CAST(__h{i} AS DOUBLE)"
        # same arithmetic as the built-in: (ceil - pos) * lo + (pos - floor) * hi
        cols.append(f"CASE WHEN floor{pos} = ceil{pos} OR {lo} = {hi} THEN {lo} "
                    f"ELSE (ceil{pos} - {pos}) * {lo} + ({pos} - floor{pos}) * {hi} END AS {q(n)}")
    return picked.selectExpr(*[q(k) for k in keys], *cols)


def _ranks_bucketed(counts: DataFrame, keys: list[str], value: str, width: int | None) -> DataFrame:
    """Running counts without sorting a whole group in one task.

    Values fall into ordered buckets: ``[b·width, (b+1)·width)`` for integral
    values, or for other values the ``RANGE_BUCKETS`` ranges between quantiles
    of the group's distinct values (one sketch per group, combined before the
    shuffle; the range is found by bisection).  Crowded values get narrow
    ranges, so an outlier empties no bucket.  Bucket totals (one row per
    non-empty bucket) give each bucket its rank offset; the running count then
    only runs *within* a bucket.  Groups are carried as one non-null struct, so NULL
    group keys match in the join without special handling.  Rows with a NULL
    value fall into bucket 0 with count 0 instead of being filtered out: no
    filter can then make the two uses of ``counts`` differ, and their shuffle
    is reused.
    """
    q = _quote
    vq = q(value)
    known = f"CASE WHEN {vq} IS NULL THEN 0L ELSE __c END AS __c"
    grp = f"named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {q(k)}' for k in keys)})" if keys else "0"
    if width is not None:
        cb = counts.selectExpr(f"{grp} AS __g", vq, known,
                               f"coalesce(({vq} - pmod({vq}, {width}L)) div {width}L, 0L) AS __bk")
    else:
        base = counts.selectExpr(f"{grp} AS __g", vq, known)
        probs = [i / RANGE_BUCKETS for i in range(1, RANGE_BUCKETS)]
        bounds = base.groupBy("__g").agg(F.percentile_approx(vq, probs, BOUNDS_ACCURACY).alias("__bounds"))
        bucket = F.coalesce(bisect_right("__bounds", vq, RANGE_BUCKETS), F.lit(0)).cast("bigint")
        cb = join_groups(base, bounds, ["__g"]).select("__g", vq, "__c", bucket.alias("__bk"))
    offsets = cb.groupBy("__g", "__bk").agg(F.sum("__c").alias("__bc")).selectExpr(
        "__g", "__bk",
        "sum(__bc) OVER (PARTITION BY __g ORDER BY __bk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        " - __bc AS __off",
        "sum(__bc) OVER (PARTITION BY __g) AS __n",
    )
    ranked = cb.join(offsets, ["__g", "__bk"]).selectExpr(
        "__g", vq, "__c", "__n",
        "__off + sum(__c) OVER (PARTITION BY __g, __bk ORDER BY " + vq
        + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __hi",
    )
    return ranked.selectExpr(*[f"__g.{q(k)} AS {q(k)}" for k in keys], vq, "__c", "__hi", "__n")


def iqr_summary(
    df: DataFrame,
    keys: Sequence[str] | str | None = ("user_type",),
    value: str = "duration_sec",
    k: float = K.IQR_K,
    method: str = "counts",
) -> DataFrame:
    """Per group: ``q1, med, q3, iqr, lower, upper`` (Tukey fences at ``k``·IQR)."""
    keys = _keys(keys)
    return _fences(quantiles(df, keys, value, *QUARTILES, method=method), keys, k)


def _fences(quartiles: DataFrame, keys: Sequence[str], k: float) -> DataFrame:
    kk = f"{float(k)!r}D"
    return quartiles.selectExpr(
        *[_quote(c) for c in keys], "q1", "med", "q3", "q3 - q1 AS iqr",
        f"q1 - {kk} * (q3 - q1) AS lower", f"q3 + {kk} * (q3 - q1) AS upper",
    )


def flag_outliers(
    df: DataFrame,
    keys: Sequence[str] | str | None = ("user_type",),
    value: str = "duration_sec",
    k: float = K.IQR_K,
    bounds: DataFrame | None = None,
    method: str = "counts",
) -> DataFrame:
    """Rows with their group's fences and ``is_outlier``, ``is_outlier_left``,
    ``is_outlier_right``.  Fences come from :func:`iqr_summary` of the same
    rows unless ``bounds`` is given.  NULL keys match NULL keys."""
    keys = _keys(keys)
    if bounds is None:
        bounds = iqr_summary(df, keys, value, k, method=method)
    b = bounds.select(*keys, "lower", "upper")
    v = F.col(value)
    return join_group_table(df, b, keys).select(
        "*",
        (v < F.col("lower")).alias("is_outlier_left"),
        (v > F.col("upper")).alias("is_outlier_right"),
        ((v < F.col("lower")) | (v > F.col("upper"))).alias("is_outlier"),
    )


def outlier_summary(
    df: DataFrame, keys: Sequence[str] | str, value: str = "duration_sec", k: float = K.IQR_K,
    by: Sequence[str] | str | None = None,
) -> DataFrame:
    """Per group of ``keys`` (and ``by``): ``total`` rows, ``known`` rows with a
    value, ``outlier_left`` and ``outlier_right``, and the fences of the
    ``keys`` group they were counted against.

    Fences and counts both come from :func:`value_counts`: the rows are
    scanned once and never joined, the fences meet one row per distinct value.
    """
    keys, by = _keys(keys), _keys(by)
    counts = value_counts(df, keys + by, value)
    fences = _fences(_quantiles_of_counts(counts, keys, value, *QUARTILES), keys, k)
    v = F.col(value)

    def rows(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("__c"))), F.lit(0).cast("bigint"))

    return join_groups(counts, fences, keys).groupBy(*keys, *by).agg(
        F.sum("__c").alias("total"),
        rows(v.isNotNull()).alias("known"),
        rows(v < F.col("lower")).alias("outlier_left"),
        rows(v > F.col("upper")).alias("outlier_right"),
        *[F.max(c).alias(c) for c in ("q1", "med", "q3", "iqr", "lower", "upper")],
    )


def outlier_share(
    df: DataFrame, keys: Sequence[str] | str = ("user_type",), value: str = "duration_sec", k: float = K.IQR_K,
) -> DataFrame:
    """``total, outliers, pct`` per group (pct in percent)."""
    outliers = (F.col("outlier_left") + F.col("outlier_right")).alias("outliers")
    out = outlier_summary(df, keys, value, k).select(*_keys(keys), "total", outliers)
    return out.withColumn("pct", F.col("outliers") / F.col("total") * 100)


def outlier_tails(
    df: DataFrame, keys: Sequence[str] | str = ("user_type",), value: str = "duration_sec", k: float = K.IQR_K,
) -> DataFrame:
    """``total, outlier_left, outlier_right, pct_left, pct_right`` per group."""
    return outlier_summary(df, keys, value, k).select(
        *_keys(keys), "total", "outlier_left", "outlier_right",
        (F.col("outlier_left") / F.col("total") * 100).alias("pct_left"),
        (F.col("outlier_right") / F.col("total") * 100).alias("pct_right"),
    )


def iqr_with_outlier_pct(
    df: DataFrame, keys: Sequence[str] | str, value: str = "duration_sec", k: float = K.IQR_K,
) -> DataFrame:
    """IQR summary plus the percentage of the group's values outside its own fences."""
    outside = (F.col("outlier_left") + F.col("outlier_right")).cast("double")
    return outlier_summary(df, keys, value, k).select(
        *_keys(keys), "q1", "med", "q3", "iqr", "lower", "upper",
        (F.try_divide(outside, F.col("known")) * 100).alias("outlier_pct"),
    )


# ------------------------------------------------------------------- shares
def share_within(
    counts: DataFrame, within: Sequence[str] | str, count_col: str = "n",
    scale: float = 1.0, name: str = "pct",
) -> DataFrame:
    """Add ``name = count / sum(count) over the `within` group × scale``.

    Runs on an already aggregated table (one row per counted key), so the
    window partition holds one row per key value, not per trip.
    """
    within = _keys(within)
    if not within:
        raise ValueError("share_within needs a group: one over all rows would be a single task")
    total = F.sum(count_col).over(Window.partitionBy(*within))
    share = F.try_divide(F.col(count_col).cast("double"), total.cast("double"))  # NULL for a 0 total
    if scale != 1.0:
        share = share * F.lit(scale)
    return counts.withColumn(name, share)


def count_share(
    df: DataFrame, count_keys: Sequence[str], within: Sequence[str] | str,
    scale: float = 1.0, name: str = "pct", totals: str = "window",
) -> DataFrame:
    """``groupBy(count_keys).count()`` as ``n`` plus its share within ``within``.

    ``totals="window"`` divides by a window sum (fine when a group has a few
    counted keys); ``totals="join"`` aggregates the group totals separately
    and attaches them with :func:`join_groups`, so a group with very many keys
    (routes) is never gathered into one task; the counts are aggregated once.
    """
    counts = df.groupBy(*count_keys).agg(F.count(F.lit(1)).alias("n"))
    within = _keys(within)
    if totals == "window":
        return share_within(counts, within, "n", scale, name)
    tot = counts.groupBy(*within).agg(F.sum("n").alias("__total"))
    share = F.try_divide(F.col("n").cast("double"), F.col("__total").cast("double"))
    if scale != 1.0:
        share = share * F.lit(scale)
    return join_groups(counts, tot, within).select(*counts.columns, share.alias(name))


# --------------------------------------------------------------- densify
def densify(
    counts: DataFrame, groups: Sequence[str], key: str, lo: int, hi: int, fill: dict[str, object],
    carry: Sequence[str] = (), bounded: bool = False,
) -> DataFrame:
    """Every integer ``key`` in ``[lo, hi]`` for every group; missing rows get
    ``fill``.  Rows with a NULL key, or one outside the domain, stay as they are.
    ``bounded`` states that no key is outside the domain (NULL may occur): the
    counts are then read once.

    ``counts`` must be one row per ``(groups…, key)`` (an aggregate).  Inside
    the domain each group gathers at most ``hi - lo + 1`` entries into a map;
    the domain is then exploded from that map.  ``carry`` columns are constant
    within a group and are copied to every key.
    """
    groups, carry = list(groups), list(carry)
    values = [c for c in counts.columns if c not in groups and c != key and c not in carry]
    kt = counts.schema[key].dataType
    inside = F.coalesce(F.col(key).between(lo, hi), F.lit(False))
    entries = F.collect_list(F.when(inside, F.struct(F.col(key), F.struct(*values))))
    per_group = counts.groupBy(*groups).agg(
        F.map_from_entries(entries).alias("__m"),
        F.max(F.when(F.col(key).isNull(), F.struct(*values))).alias("__null"),  # one row per group at most
        *[F.max(c).alias(c) for c in carry],
    )
    domain = F.sequence(F.lit(lo).cast(kt), F.lit(hi).cast(kt))
    with_null = F.concat(domain, F.array(F.lit(None).cast(kt)))
    domain = F.when(F.col("__null").isNull(), domain).otherwise(with_null)
    dom = per_group.select(*groups, *carry, "__m", "__null", F.explode(domain).alias(key))
    hit = F.when(F.col(key).isNull(), F.col("__null")).otherwise(
        F.try_element_at(F.col("__m"), F.coalesce(F.col(key), F.lit(lo).cast(kt))))
    cols = [F.when(F.col(key).isNull(), hit[c]).otherwise(F.coalesce(hit[c], F.lit(fill[c]))).alias(c)
            if c in fill else hit[c].alias(c) for c in values]
    dense = dom.select(*groups, key, *carry, *cols)
    if bounded:
        return dense
    outside = counts.where(~inside & F.col(key).isNotNull()).select(*groups, key, *carry, *values)
    return dense.unionByName(outside)


# ------------------------------------------------------------- histogram
def histogram(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    bins: int,
    scale_keys: Sequence[str] | None = None,
    log10: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Equal-width histogram of ``value`` per group of ``keys``.

    Bin definition (a fixed convention): over the range [min, max] of the
    *scale group* (``scale_keys``, default all of ``keys``; groups in one
    scale group share the bins), width ``w = (max - min) / (bins - 1)``;
    bin ``i`` (0-based) is the right-closed interval
    ``(min - w/2 + i·w, min - w/2 + (i+1)·w]``, so the first bin is centred
    on ``min`` and the last on ``max``.  The bounds of all bins are one array
    per scale group: a value is looked up in it by bisection, and ``bin_lo``
    and ``bin_hi`` are its entries, so ``bin_lo < x <= bin_hi`` holds to the
    last bit.  ``log10=True`` bins ``log10(value)``
    over positive values only.  Empty bins are emitted with ``n = 0``.
    ``weight`` names a column saying how many values a row stands for.
    Output: ``keys…, bin, bin_lo, bin_hi, n``.

    Plan: one aggregate over the rows, by distinct value; the range per scale
    group and the bins both come from it, then :func:`densify`.
    """
    keys = list(keys)
    scale_keys = list(scale_keys) if scale_keys is not None else keys
    x = F.log10(F.col(value)) if log10 else F.col(value).cast("double")
    base = df.where(F.col(value) > 0) if log10 else df.where(F.col(value).isNotNull())
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    rows = base.groupBy(*keys, value).agg(n.alias("__c")).select(*keys, x.alias("__x"), "__c")
    # reading the count here keeps both uses of ``rows`` the same aggregate: a
    # plain min/max would be planned on the raw rows, with a second scan
    used = F.when(F.col("__c") > 0, F.col("__x"))
    width = (F.col("__max") - F.col("__min")) / F.lit(float(bins - 1))
    stats = (
        rows.groupBy(*scale_keys)
        .agg(F.min(used).alias("__min"), F.max(used).alias("__max"))
        .select(*scale_keys, "__min", F.when(width > 0, width).otherwise(F.lit(1.0)).alias("__w"))
        .select(*scale_keys, (F.col("__min") - F.col("__w") / 2).alias("__b"), "__w")
    )
    edges = F.expr(f"transform(sequence(0, {bins}), i -> __b + i * __w)")
    stats = stats.withColumn("__edges", edges)
    idx = F.least(F.greatest(bisect_left("__edges", "__x", bins + 1) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = (
        join_groups(rows, stats, scale_keys)
        .groupBy(*keys, idx.alias("bin"))
        .agg(F.sum("__c").alias("n"), F.max("__b").alias("__b"), F.max("__w").alias("__w"))
    )
    out = densify(counts, keys, "bin", 0, bins - 1, {"n": 0}, carry=("__b", "__w"), bounded=True)
    return out.select(
        *keys, "bin",
        (F.col("__b") + F.col("bin") * F.col("__w")).alias("bin_lo"),  # the entries of __edges
        (F.col("__b") + (F.col("bin") + 1) * F.col("__w")).alias("bin_hi"),
        F.col("n").cast("bigint").alias("n"),
    )
