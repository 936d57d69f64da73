"""Independent SQL (DuckDB dialect) for every catalog query.

Each statement starts from the raw test tables and re-derives the two trip
views inline (``WITH`` clauses), so it checks the whole Spark pipeline, not
just the last step.  Used only as a correctness oracle.
"""

from __future__ import annotations


class K:
    """The fixed values as the reference analysis states them, written out here
    so that a wrong constant of the library cannot pass both sides."""

    PEAK_WINDOWS = ((7, 9), (15, 18))
    AGE_BREAKS = (0, 18, 25, 35, 45, 55, 65, 120)
    AGE_BREAKS_COARSE = (18, 25, 35, 45, 55, None)
    IQR_K = 1.5
    PEAK_CUTOFF_PCT = 35.55
    ADJACENT_DELTA_PCT = 2.0
    FLAT_RUN = 2
    MONTH_SECONDS = 2_592_000
    MAX_PLAUSIBLE_AGE = 98
    BIRTH_YEAR_RANGE = (1925, 2019)
    AS_OF_YEAR = 2019
    LEGACY_YEAR = 2019
    MODERN_YEAR = 2020
    DURATION_HIST_BINS = 30
    ROUTE_HIST_BINS = 50
    TOP_ROUTES = 10



def _age_case(breaks, kind: str) -> str:
    parts = []
    for i in range(len(breaks) - 1):
        lo, hi = breaks[i], breaks[i + 1]
        cond = f"age >= {lo}" if hi is None else f"age >= {lo} AND age < {hi}"
        label = f"[{lo},{'Inf' if hi is None else hi})"
        val = f"'{label}'" if kind == "label" else str(i + 1)
        parts.append(f"WHEN {cond} THEN {val}")
    return "CASE " + " ".join(parts) + " END"


def _peak(col: str = "start_hour") -> str:
    return "(" + " OR ".join(f"({col} BETWEEN {a} AND {b})" for a, b in K.PEAK_WINDOWS) + ")"


_ENRICH = """
    COALESCE(CAST(start_station_id AS VARCHAR), 'NA') || '_' || COALESCE(CAST(end_station_id AS VARCHAR), 'NA') AS route_id,
    strftime(start_time, '%a') AS weekday,
    CAST(dayofweek(start_time) + 1 AS INTEGER) AS weekday_num,
    CAST(date_sub('microsecond', start_time, end_time) AS DOUBLE) / CAST(60000000 AS DOUBLE) AS duration_min,
    CAST(hour(start_time) AS INTEGER) AS start_hour,
    dayofweek(start_time) IN (0, 6) AS is_weekend,
    start_station_id = end_station_id AS round_trip"""

_COMMON = ("trip_id, start_time, end_time, start_station_id, start_station_name, end_station_id, "
           "end_station_name, user_type, duration_sec")

CTES = f"""
legacy_base AS (
  SELECT l.l_orderkey * 10 + l.l_linenumber AS trip_id,
         l.l_shipdate + to_seconds((l.l_orderkey * 7919 + l.l_partkey * 104729 + l.l_suppkey * 613) % 86400) AS start_time,
         CAST(floor(l.l_extendedprice / 50) AS BIGINT) * (CASE WHEN l.l_partkey % 40 = 0 THEN 20 ELSE 1 END) AS tripduration,
         CASE WHEN l.l_orderkey % 1000 = 0 THEN 90 ELSE 0 END AS drift,
         l.l_partkey AS bikeid,
         l.l_suppkey % 50 + 1 AS from_station_id,
         l.l_partkey % 50 + 1 AS to_station_id,
         CASE WHEN c.c_custkey % 211 = 0 THEN 'Dependent'
              WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 'Customer' ELSE 'Subscriber' END AS usertype,
         CASE WHEN c.c_custkey % 13 = 0 THEN NULL WHEN c.c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
         CASE WHEN c.c_custkey % 17 = 0 THEN NULL WHEN c.c_custkey % 97 = 0 THEN 1890
              ELSE 1930 + c.c_custkey % 80 END AS birthyear
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
),
legacy AS (
  SELECT trip_id, start_time, start_time + to_seconds(tripduration + drift) AS end_time, bikeid, tripduration,
         from_station_id, 'Station ' || CAST(from_station_id AS VARCHAR) AS from_station_name,
         to_station_id, 'Station ' || CAST(to_station_id AS VARCHAR) AS to_station_name,
         usertype, gender, CAST(birthyear AS BIGINT) AS birthyear
  FROM legacy_base
),
modern_base AS (
  SELECT 'R' || CAST(event_id AS VARCHAR) AS ride_id, 'docked_bike' AS rideable_type, ts AS started_at,
         ts + to_seconds(CASE WHEN event_id % 500 = 0 THEN -60 ELSE CAST(floor(value * 60) AS BIGINT) END) AS ended_at,
         user_id % 50 + 1 AS start_station_id,
         CASE WHEN event_id % 997 = 0 THEN NULL
              ELSE CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 50 + 1 END AS end_station_id,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'casual' ELSE 'member' END AS member_casual
  FROM events
),
modern AS (
  SELECT ride_id, rideable_type, started_at, ended_at,
         'Station ' || CAST(start_station_id AS VARCHAR) AS start_station_name, start_station_id,
         'Station ' || CAST(end_station_id AS VARCHAR) AS end_station_name, end_station_id,
         CAST(41.8 AS DOUBLE) + start_station_id * CAST(0.001 AS DOUBLE) AS start_lat,
         CAST(-87.6 AS DOUBLE) - start_station_id * CAST(0.001 AS DOUBLE) AS start_lng,
         CAST(41.8 AS DOUBLE) + end_station_id * CAST(0.001 AS DOUBLE) AS end_lat,
         CAST(-87.6 AS DOUBLE) - end_station_id * CAST(0.001 AS DOUBLE) AS end_lng,
         member_casual
  FROM modern_base
),
legacy_canon AS (
  SELECT trip_id, start_time, end_time, bikeid AS bike_id, from_station_id AS start_station_id,
         from_station_name AS start_station_name, to_station_id AS end_station_id,
         to_station_name AS end_station_name,
         CASE WHEN usertype = 'Subscriber' THEN 'member' WHEN usertype = 'Customer' THEN 'casual' END AS user_type,
         gender, CAST(birthyear AS INTEGER) AS birth, date_sub('second', start_time, end_time) AS duration_sec
  FROM legacy
),
modern_canon AS (
  SELECT ride_id AS trip_id, started_at AS start_time, ended_at AS end_time, start_station_id,
         start_station_name, end_station_id, end_station_name, start_lat, start_lng, end_lat, end_lng,
         member_casual AS user_type, date_sub('second', started_at, ended_at) AS duration_sec
  FROM modern
  WHERE started_at < ended_at AND end_station_id IS NOT NULL
),
stacked AS (
  SELECT CAST(trip_id AS VARCHAR) AS trip_id, start_time, end_time, start_station_id, start_station_name,
         end_station_id, end_station_name, user_type, duration_sec, CAST({K.LEGACY_YEAR} AS INTEGER) AS year
  FROM legacy_canon
  UNION ALL
  SELECT {_COMMON}, CAST({K.MODERN_YEAR} AS INTEGER) AS year FROM modern_canon
),
enriched AS (SELECT *, {_ENRICH} FROM stacked),
trips AS (SELECT *, {_peak()} AS is_peak FROM enriched),
demo_base AS (
  SELECT *, CAST({K.AS_OF_YEAR} - birth AS INTEGER) AS age FROM legacy_canon
  WHERE gender IS NOT NULL AND birth IS NOT NULL
),
demo_enriched AS (SELECT *, {_ENRICH} FROM demo_base),
demo AS (
  SELECT *, {_peak()} AS is_peak, {_age_case(K.AGE_BREAKS, 'label')} AS age_group,
         {_age_case(K.AGE_BREAKS, 'rank')} AS age_rank, log10(duration_sec + 1) AS duration_log10
  FROM demo_enriched
)"""


def sql(body: str, extra: str = "") -> str:
    """Full statement: the shared views, optional extra CTEs, then ``body``."""
    ctes = CTES + ("," + extra if extra else "")
    return f"WITH {ctes}\n{body}"


# ----------------------------------------------------------------- helpers
def _iqr_cols(src: str, keys: str, where: str = "") -> str:
    w = f"WHERE {where}" if where else ""
    return f"""SELECT {keys}, q1, med, q3, q3 - q1 AS iqr,
       q1 - CAST({K.IQR_K} AS DOUBLE) * (q3 - q1) AS lower, q3 + CAST({K.IQR_K} AS DOUBLE) * (q3 - q1) AS upper
FROM (SELECT {keys}, quantile_cont(duration_sec, 0.25) AS q1, quantile_cont(duration_sec, 0.5) AS med,
             quantile_cont(duration_sec, 0.75) AS q3
      FROM {src} {w} GROUP BY {keys}) q"""


def _flagged(where: str) -> str:
    """Peak / off-peak trips joined to their own group's fences."""
    return f"""
b AS ({_iqr_cols('trips', 'year, user_type', where)}),
f AS (
  SELECT t.year, t.trip_id, t.user_type, t.duration_sec, b.lower, b.upper,
         t.duration_sec < b.lower AS is_outlier_left, t.duration_sec > b.upper AS is_outlier_right,
         (t.duration_sec < b.lower OR t.duration_sec > b.upper) AS is_outlier
  FROM trips t LEFT JOIN b ON t.year = b.year AND t.user_type IS NOT DISTINCT FROM b.user_type
  WHERE {where.replace('is_peak', 't.is_peak')}
)"""


def _share(src: str, count_keys: str, within: str, scale: str = "", name: str = "pct", where: str = "") -> str:
    w = f"WHERE {where}" if where else ""
    part = f"PARTITION BY {within}" if within else ""
    sc = f" * {scale}" if scale else ""
    return (f"SELECT {count_keys}, count(*) AS n, "
            f"count(*) / sum(count(*)) OVER ({part}){sc} AS {name} FROM {src} {w} GROUP BY {count_keys}")


def _histogram(src: str, keys: list[str], scale_keys: list[str], x: str, bins: int, where: str, tag: str) -> str:
    """CTEs ``{tag}_r, {tag}_s, {tag}_c, {tag}_d`` and the final select text."""
    k = ", ".join(keys)
    sk = ", ".join(scale_keys)
    on_s = " AND ".join(f"r.{c} IS NOT DISTINCT FROM s.{c}" for c in scale_keys)
    on_c = " AND ".join(f"d.{c} IS NOT DISTINCT FROM c.{c}" for c in keys) + " AND d.bin = c.bin"
    on_ds = " AND ".join(f"d.{c} IS NOT DISTINCT FROM s.{c}" for c in scale_keys)
    rk = ", ".join(f"r.{c}" for c in keys)
    ctes = f"""
{tag}_r AS (SELECT {k}, {x} AS x FROM {src} WHERE {where}),
{tag}_s AS (
  SELECT {sk}, list_transform(range({bins + 1}), lambda i: mn - w / 2 + i * w) AS edges FROM (
    SELECT {sk}, mn, CASE WHEN (mx - mn) / CAST({bins - 1} AS DOUBLE) > 0
                          THEN (mx - mn) / CAST({bins - 1} AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS w
    FROM (SELECT {sk}, min(x) AS mn, max(x) AS mx FROM {tag}_r GROUP BY {sk}) m) z
),
{tag}_c AS (
  SELECT {rk}, CAST(least(greatest(len(list_filter(s.edges, lambda e: e < r.x)) - 1, 0), {bins - 1}) AS INTEGER) AS bin,
         count(*) AS n
  FROM {tag}_r r JOIN {tag}_s s ON {on_s}
  GROUP BY ALL
),
{tag}_d AS (
  SELECT g.*, CAST(unnest(range({bins})) AS INTEGER) AS bin FROM (SELECT DISTINCT {k} FROM {tag}_c) g
)"""
    dk = ", ".join(f"d.{c}" for c in keys)
    body = f"""SELECT {dk}, d.bin, s.edges[d.bin + 1] AS bin_lo, s.edges[d.bin + 2] AS bin_hi,
       CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM {tag}_d d LEFT JOIN {tag}_c c ON {on_c} JOIN {tag}_s s ON {on_ds}"""
    return ctes, body


# --------------------------------------------------------- quality rule text
def _dur(s="start_time", e="end_time", unit="second"):
    return f"date_sub('{unit}', {s}, {e})"


LEGACY_RULES = {
    "missing_id_rows": "trip_id IS NULL OR bikeid IS NULL OR from_station_id IS NULL OR to_station_id IS NULL",
    "missing_name_or_user": "from_station_name IS NULL OR to_station_name IS NULL OR usertype IS NULL",
    "missing_gender_or_birth": "gender IS NULL OR birthyear IS NULL",
    "constraint_violation": "bikeid <= 0 OR tripduration <= 0",
    "logical_issues": f"start_time > end_time OR tripduration <> {_dur()} OR birthyear < {K.BIRTH_YEAR_RANGE[0]} "
                      f"OR birthyear > {K.BIRTH_YEAR_RANGE[1]}",
    "duration_mismatch": f"tripduration <> {_dur()}",
    "duration_mismatch_over_1min": f"abs(tripduration - {_dur()}) > 60",
    "long_rentals": f"{_dur()} > {K.MONTH_SECONDS}",
    "short_round_trips_le_3min": f"{_dur(unit='minute')} <= 3 AND from_station_name = to_station_name",
    "implausible_age": f"{K.AS_OF_YEAR} - birthyear > {K.MAX_PLAUSIBLE_AGE}",
    "inverted_times": "start_time > end_time",
}
_MD = _dur("started_at", "ended_at")
_MM = _dur("started_at", "ended_at", "minute")
MODERN_RULES = {
    "missing_id_rows": "ride_id IS NULL OR start_station_id IS NULL OR end_station_id IS NULL",
    "missing_destination": "end_station_id IS NULL",
    "long_rentals": f"{_MD} > {K.MONTH_SECONDS}",
    "short_round_trips_lt_2min": f"{_MM} < 2 AND start_station_name = end_station_name",
    "short_round_trips_lt_3min": f"{_MM} < 3 AND start_station_name = end_station_name",
    "inverted_times": "started_at > ended_at",
    "invalid_coordinates": "start_lat IS NULL OR abs(start_lat) > 90 OR end_lat IS NULL OR abs(end_lat) > 90 "
                           "OR start_lng IS NULL OR abs(start_lng) > 180 OR end_lng IS NULL OR abs(end_lng) > 180",
}


def _counts(rules: dict, names, table: str, extra: dict | None = None, year: int | None = None,
            all_names=None) -> str:
    cols = []
    for n in (all_names or names):
        if n in names:
            cols.append(f"count_if({rules[n]}) AS {n}" if n in rules else f"{extra[n]} AS {n}")
        else:
            cols.append(f"CAST(NULL AS BIGINT) AS {n}")
    if year is not None:
        cols.append(f"CAST({year} AS INTEGER) AS year")
    return f"SELECT {', '.join(cols)} FROM {table}"


LEGACY_COLS = ["trip_id", "start_time", "end_time", "bikeid", "tripduration", "from_station_id",
               "from_station_name", "to_station_id", "to_station_name", "usertype", "gender", "birthyear"]
MODERN_COLS = ["ride_id", "rideable_type", "started_at", "ended_at", "start_station_name", "start_station_id",
               "end_station_name", "end_station_id", "start_lat", "start_lng", "end_lat", "end_lng",
               "member_casual"]


def _quality_report() -> str:
    lnames = ["n_rows", *LEGACY_RULES, "max_duration_sec"]
    mnames = ["n_rows", *MODERN_RULES, "max_duration_sec"]
    all_names = list(dict.fromkeys(lnames + mnames))
    a = _counts(LEGACY_RULES, lnames, "legacy", {"n_rows": "count(*)", "max_duration_sec": f"max({_dur()})"},
                K.LEGACY_YEAR, all_names)
    b = _counts(MODERN_RULES, mnames, "modern", {"n_rows": "count(*)", "max_duration_sec": f"max({_MD})"},
                K.MODERN_YEAR, all_names)
    return sql(f"{a}\nUNION ALL\n{b}")


def _constant_columns() -> str:
    parts = []
    for c in MODERN_COLS:
        nn = f"count_if({c} IS NULL)"
        parts.append(
            f"SELECT '{c}' AS column_name, {nn} AS null_count, count(*) AS n_rows, "
            f"COALESCE((min({c}) = max({c}) AND {nn} = 0) OR {nn} = count(*), false) AS is_constant FROM modern")
    return sql("\nUNION ALL\n".join(parts))


def _null_profile(view: str, columns: list[str]) -> str:
    return sql("\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS null_count FROM {view}" for c in columns))


_RANKED = """
rs AS (SELECT user_type, route_id, count(*) AS trip_count FROM trips GROUP BY user_type, route_id),
rk AS (
  SELECT *, row_number() OVER w AS route_rank,
         sum(trip_count) OVER (PARTITION BY user_type) AS group_trips,
         sum(trip_count) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_trips
  FROM rs WINDOW w AS (PARTITION BY user_type ORDER BY trip_count DESC, route_id ASC)
)"""

_RANKED_COLS = ("user_type, route_id, trip_count, CAST(route_rank AS INTEGER) AS route_rank, "
                "trip_count / group_trips AS trip_pct, cum_trips / group_trips AS cum_trip_pct")

_ROUTE_SHARE = "rsh AS (" + _share("trips", "year, user_type, route_id", "year, user_type", "100",
                                    where="user_type IN ('member', 'casual')") + ")"

_HOURS = """
hc AS (SELECT year, start_hour, count(*) AS n FROM trips GROUP BY year, start_hour),
dom AS (SELECT y.year, CAST(h.start_hour AS INTEGER) AS start_hour
        FROM (SELECT DISTINCT year FROM hc) y, (SELECT unnest(range(24)) AS start_hour) h),
dense AS (SELECT d.year, d.start_hour, COALESCE(hc.n, 0) AS n
          FROM dom d LEFT JOIN hc ON d.year = hc.year AND d.start_hour = hc.start_hour),
ranked AS (
  SELECT *, row_number() OVER w AS hour_rank, max(n) OVER (PARTITION BY year) AS mx, lag(n) OVER w AS prev
  FROM dense WINDOW w AS (PARTITION BY year ORDER BY n DESC, start_hour ASC)
),
thr AS (
  SELECT year, start_hour, n, CAST(hour_rank AS INTEGER) AS hour_rank,
         CASE WHEN hour_rank = 1 THEN CAST(100 AS DOUBLE)
              ELSE round_even(CAST(n AS DOUBLE) / CAST(mx AS DOUBLE) * 100, 2) END AS pct_to_max,
         CASE WHEN hour_rank = 1 THEN CAST(0 AS DOUBLE) WHEN prev = 0 THEN NULL
              ELSE round_even((1 - CAST(n AS DOUBLE) / CAST(prev AS DOUBLE)) * 100, 2) END AS delta_to_above
  FROM ranked
)"""



def _curve_break(keys: str) -> str:
    """Per group: the first rank after which FLAT_RUN steps in a row are flat,
    by looking at every rank and the next ones."""
    hours = _HOURS if keys == "year" else _HOURS_USER
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys.split(", "))
    ak = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""{hours},
flat AS (
  SELECT *, COALESCE(hour_rank > 1 AND delta_to_above < CAST({K.ADJACENT_DELTA_PCT} AS DOUBLE), false) AS is_flat FROM thr
),
runs AS (
  SELECT {ak}, a.hour_rank, a.start_hour, a.pct_to_max,
         COALESCE(min(CASE WHEN NOT b.is_flat THEN b.hour_rank END), max(b.hour_rank) + 1) - a.hour_rank AS steps
  FROM flat a JOIN flat b ON {on} AND b.hour_rank >= a.hour_rank WHERE a.is_flat
  GROUP BY {ak}, a.hour_rank, a.start_hour, a.pct_to_max
),
brk AS (
  SELECT {ak}, b.hour_rank AS break_rank, b.start_hour AS break_hour, b.pct_to_max AS detected_cutoff,
         CAST(COALESCE(b.steps, 0) AS BIGINT) AS flat_steps
  FROM (SELECT DISTINCT {keys} FROM flat) a
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY hour_rank) AS nr FROM runs WHERE steps >= {K.FLAT_RUN}) b
    ON {on} AND b.nr = 1
)"""


_HOURS_USER = """
hc AS (SELECT year, user_type, start_hour, count(*) AS n FROM trips GROUP BY year, user_type, start_hour),
dom AS (SELECT y.year, y.user_type, CAST(h.start_hour AS INTEGER) AS start_hour
        FROM (SELECT DISTINCT year, user_type FROM hc) y, (SELECT unnest(range(24)) AS start_hour) h),
dense AS (SELECT d.year, d.user_type, d.start_hour, COALESCE(hc.n, 0) AS n
          FROM dom d LEFT JOIN hc ON d.year = hc.year AND d.user_type IS NOT DISTINCT FROM hc.user_type
           AND d.start_hour = hc.start_hour),
ranked AS (
  SELECT *, row_number() OVER w AS hour_rank, max(n) OVER (PARTITION BY year, user_type) AS mx, lag(n) OVER w AS prev
  FROM dense WINDOW w AS (PARTITION BY year, user_type ORDER BY n DESC, start_hour ASC)
),
thr AS (
  SELECT year, user_type, start_hour, n, CAST(hour_rank AS INTEGER) AS hour_rank,
         CASE WHEN hour_rank = 1 THEN CAST(100 AS DOUBLE)
              ELSE round_even(CAST(n AS DOUBLE) / CAST(mx AS DOUBLE) * 100, 2) END AS pct_to_max,
         CASE WHEN hour_rank = 1 THEN CAST(0 AS DOUBLE) WHEN prev = 0 THEN NULL
              ELSE round_even((1 - CAST(n AS DOUBLE) / CAST(prev AS DOUBLE)) * 100, 2) END AS delta_to_above
  FROM ranked
)"""

_PEAK_SHARE = ("SELECT year, user_type, count_if(is_peak) AS n_peak, count(*) AS n_total, "
               "count_if(is_peak) / count(*) * 100 AS peak_pct FROM {src} GROUP BY year, user_type")


# the modern trips, and the legacy trips of riders with gender and birth year
_DEMO_BOTH = ("demo_both AS (SELECT * FROM trips WHERE year = 2020 "
              "OR trip_id IN (SELECT CAST(trip_id AS VARCHAR) FROM demo_base))")


def _route_hist() -> str:
    c1, b1 = _histogram("rsh", ["year", "user_type"], ["year", "user_type"], "pct", K.ROUTE_HIST_BINS,
                        "pct IS NOT NULL", "hy")
    c2, b2 = _histogram("rsh", ["user_type"], ["user_type"], "pct", K.ROUTE_HIST_BINS, "pct IS NOT NULL", "ha")
    b2 = b2.replace("SELECT d.user_type,", "SELECT CAST(NULL AS INTEGER) AS year, d.user_type,", 1)
    return sql(f"{b1}\nUNION ALL\n{b2}", _ROUTE_SHARE + "," + c1 + "," + c2)


def _duration_hist() -> str:
    c, b = _histogram("trips", ["year", "is_peak", "user_type"], ["year", "is_peak"], "log10(duration_sec)",
                      K.DURATION_HIST_BINS, "duration_sec > 0", "h")
    return sql(b, c)


_LEG = ", ".join(c for c in LEGACY_COLS if c != "tripduration")
_COARSE_LABEL = _age_case(K.AGE_BREAKS_COARSE, "label")
_COARSE_RANK = _age_case(K.AGE_BREAKS_COARSE, "rank")

ORACLE_SQL: dict[str, str] = {
    # normalise / features
    "scan_legacy": sql("SELECT * FROM legacy"),
    "scan_modern": sql("SELECT * FROM modern"),
    "normalize_legacy": sql("SELECT * FROM legacy_canon"),
    "normalize_modern": sql("SELECT * FROM modern_canon"),
    "repair_duration": sql(f"SELECT {_LEG}, {_dur()} AS tripduration FROM legacy"),
    "valid_trips": sql("SELECT * FROM modern WHERE started_at < ended_at AND end_station_id IS NOT NULL"),
    "demographic_trips": sql("SELECT trip_id, user_type, gender, birth, age, duration_sec, start_time FROM demo"),
    "recode_user_type": sql(
        "SELECT usertype AS source_user_type, CASE WHEN usertype = 'Subscriber' THEN 'member' "
        "WHEN usertype = 'Customer' THEN 'casual' END AS user_type, count(*) AS n FROM legacy GROUP BY ALL"),
    "enrich_trips": sql("SELECT * EXCLUDE (is_peak) FROM trips"),
    "peak_flag": sql("SELECT year, trip_id, start_time, start_hour, is_peak FROM trips"),
    "age_groups": sql("SELECT trip_id, age, age_group, age_rank FROM demo"),
    "age_groups_coarse": sql(f"SELECT trip_id, age, {_COARSE_LABEL} AS age_band, {_COARSE_RANK} AS age_band_rank "
                             "FROM demo"),
    "duration_log10": sql("SELECT year, trip_id, duration_sec, log10(duration_sec + 1) AS duration_log10 FROM trips"),
    "entire_data": sql("SELECT * FROM trips"),
    "constant_columns": _constant_columns(),
    # quality
    "longest_trips_legacy": sql(
        "SELECT tripduration, start_time, end_time FROM legacy ORDER BY tripduration DESC NULLS LAST, "
        "start_time ASC NULLS LAST, end_time ASC NULLS LAST"),
    "longest_trips_modern": sql(
        f"SELECT {_MM} AS trip_duration_minutes, ride_id, started_at, ended_at FROM modern "
        "ORDER BY trip_duration_minutes DESC NULLS LAST, ride_id ASC NULLS LAST, started_at ASC NULLS LAST, "
        "ended_at ASC NULLS LAST"),
    "missing_id_rows": sql(f"SELECT count_if({LEGACY_RULES['missing_id_rows']}) AS missing_value FROM legacy"),
    "null_profile": _null_profile("legacy", LEGACY_COLS),
    "null_profile_modern": _null_profile("modern", MODERN_COLS),
    "constraint_violations": sql(_counts(LEGACY_RULES, ["constraint_violation"], "legacy")),
    "logical_issues": sql(_counts(LEGACY_RULES, ["logical_issues"], "legacy")),
    "duplicate_trip_ids": sql("SELECT trip_id, count(*) AS num_of_dup FROM legacy GROUP BY trip_id "
                              "HAVING count(*) > 1"),
    "duplicate_ride_ids": sql("SELECT ride_id, count(*) AS num_of_dup FROM modern GROUP BY ride_id "
                              "HAVING count(*) > 1"),
    "short_round_trips": sql(
        _counts(LEGACY_RULES, ["short_round_trips_le_3min"], "legacy", year=K.LEGACY_YEAR,
                all_names=["short_round_trips_le_3min", "short_round_trips_lt_2min", "short_round_trips_lt_3min"])
        + "\nUNION ALL\n"
        + _counts(MODERN_RULES, ["short_round_trips_lt_2min", "short_round_trips_lt_3min"], "modern",
                  year=K.MODERN_YEAR,
                  all_names=["short_round_trips_le_3min", "short_round_trips_lt_2min", "short_round_trips_lt_3min"])),
    "long_rentals": sql(
        _counts(LEGACY_RULES, ["long_rentals", "max_duration_sec"], "legacy", {"max_duration_sec": f"max({_dur()})"},
                K.LEGACY_YEAR)
        + "\nUNION ALL\n"
        + _counts(MODERN_RULES, ["long_rentals", "max_duration_sec"], "modern", {"max_duration_sec": f"max({_MD})"},
                  K.MODERN_YEAR)),
    "implausible_age": sql(_counts(LEGACY_RULES, ["implausible_age"], "legacy")),
    "duration_mismatch": sql(_counts(LEGACY_RULES, ["duration_mismatch", "duration_mismatch_over_1min"], "legacy")),
    "missing_destination": sql("SELECT * FROM modern WHERE end_station_id IS NULL"),
    "inverted_times": sql(_counts(LEGACY_RULES, ["inverted_times"], "legacy", year=K.LEGACY_YEAR) + "\nUNION ALL\n"
                          + _counts(MODERN_RULES, ["inverted_times"], "modern", year=K.MODERN_YEAR)),
    "invalid_coordinates": sql(_counts(MODERN_RULES, ["invalid_coordinates"], "modern")),
    "quality_report": _quality_report(),
    # profile
    "trips_by_hour_weekday": sql("SELECT year, user_type, start_hour, weekday, weekday_num, count(*) AS n "
                                 "FROM trips GROUP BY ALL"),
    "trips_by_hour_user": sql("SELECT year, user_type, start_hour, count(*) AS n FROM trips GROUP BY ALL"),
    "hour_threshold": sql("SELECT * FROM thr", _HOURS),
    "peak_hours_detected": sql(
        f"SELECT *, delta_to_above < CAST({K.ADJACENT_DELTA_PCT} AS DOUBLE) AS flat_step FROM thr "
        f"WHERE pct_to_max >= CAST({K.PEAK_CUTOFF_PCT} AS DOUBLE)", _HOURS),
    "peak_cutoff": sql("SELECT * FROM brk", _curve_break("year")),
    "peak_cutoff_user": sql("SELECT * FROM brk", _curve_break("year, user_type")),
    "peak_hours_by_curve": sql(
        "SELECT thr.*, brk.detected_cutoff FROM thr JOIN brk ON thr.year = brk.year "
        "WHERE thr.pct_to_max >= brk.detected_cutoff", _curve_break("year")),
    "peak_share": sql(_PEAK_SHARE.format(src="trips")),
    "peak_share_demo": sql(_PEAK_SHARE.format(src="demo_both"), _DEMO_BOTH),
    "peak_share_trimmed": sql(
        _PEAK_SHARE.format(src="kept"),
        f"""
b AS ({_iqr_cols('trips', 'year, user_type')}),
kept AS (
  SELECT t.* FROM trips t LEFT JOIN b ON t.year = b.year AND t.user_type IS NOT DISTINCT FROM b.user_type
  WHERE NOT (t.duration_sec < b.lower OR t.duration_sec > b.upper)
)"""),
    "yoy_peak_share": sql(
        f"""SELECT user_type, peak_pct_{K.LEGACY_YEAR}, peak_pct_{K.MODERN_YEAR},
       peak_pct_{K.MODERN_YEAR} - peak_pct_{K.LEGACY_YEAR} AS peak_pct_change
FROM (SELECT user_type, max(CASE WHEN year = {K.LEGACY_YEAR} THEN peak_pct END) AS peak_pct_{K.LEGACY_YEAR},
             max(CASE WHEN year = {K.MODERN_YEAR} THEN peak_pct END) AS peak_pct_{K.MODERN_YEAR}
      FROM ps GROUP BY user_type) p""",
        f"ps AS ({_PEAK_SHARE.format(src='trips')})"),
    "round_trip_share": sql(_share("trips", "year, user_type, round_trip", "year, user_type", "100",
                                   "pct_round_trip")),
    "weekend_share": sql(_share("trips", "year, user_type, is_weekend", "year, user_type")),
    "weekend_only_share": sql(
        "SELECT * FROM ws WHERE is_weekend",
        "ws AS (" + _share("trips", "year, user_type, is_weekend", "year, user_type", "100") + ")"),
    "age_user_mix": sql(_share("demo", "age_group, user_type", "age_group")),
    "age_membership_rate": sql(
        "SELECT age_group, user_type, n, round_even(pct, 2) AS pct FROM am WHERE user_type = 'member'",
        "am AS (" + _share("demo", "age_group, user_type", "age_group", "100") + ")"),
    # spread
    "iqr_all": sql(_iqr_cols("trips", "year, user_type")),
    "iqr_all_demo": sql(_iqr_cols("demo_both", "year, user_type"), _DEMO_BOTH),
    "iqr_peak": sql(_iqr_cols("trips", "year, user_type", "is_peak")),
    "iqr_offpeak": sql(_iqr_cols("trips", "year, user_type", "NOT is_peak")),
    "iqr_entire_data": sql(_iqr_cols("trips", "user_type")),
    "iqr_age_group": sql(
        """SELECT b.*, o.outlier_pct FROM b LEFT JOIN (
  SELECT d.age_group, avg(CAST((d.duration_sec < b.lower OR d.duration_sec > b.upper) AS DOUBLE)) * 100 AS outlier_pct
  FROM demo d LEFT JOIN b ON d.age_group IS NOT DISTINCT FROM b.age_group GROUP BY d.age_group
) o ON b.age_group IS NOT DISTINCT FROM o.age_group""",
        f"b AS ({_iqr_cols('demo', 'age_group')})"),
    "outlier_flags": sql("SELECT * FROM f", _flagged("is_peak")),
    "outlier_share_peak": sql(
        "SELECT year, user_type, count(*) AS total, count_if(is_outlier) AS outliers, "
        "count_if(is_outlier) / count(*) * 100 AS pct FROM f GROUP BY year, user_type", _flagged("is_peak")),
    "outlier_tails_peak": sql(
        "SELECT year, user_type, count(*) AS total, count_if(is_outlier_left) AS outlier_left, "
        "count_if(is_outlier_right) AS outlier_right, count_if(is_outlier_left) / count(*) * 100 AS pct_left, "
        "count_if(is_outlier_right) / count(*) * 100 AS pct_right FROM f GROUP BY year, user_type",
        _flagged("is_peak")),
    "outlier_tails_offpeak": sql(
        "SELECT year, user_type, count(*) AS total, count_if(is_outlier_left) AS outlier_left, "
        "count_if(is_outlier_right) AS outlier_right, count_if(is_outlier_left) / count(*) * 100 AS pct_left, "
        "count_if(is_outlier_right) / count(*) * 100 AS pct_right FROM f GROUP BY year, user_type",
        _flagged("NOT is_peak")),
    "duration_log_histogram": _duration_hist(),
    # routes
    "route_share": sql("SELECT * FROM rsh", _ROUTE_SHARE),
    "route_share_stacked": sql("SELECT user_type, route_id, n, pct FROM rsh", _ROUTE_SHARE),
    "route_share_iqr": sql(
        """SELECT year, user_type,
       quantile_cont(n, 0.5) / CAST(sum(n) AS BIGINT) * 100 AS med,
       quantile_cont(n, 0.25) / CAST(sum(n) AS BIGINT) * 100 AS q1,
       quantile_cont(n, 0.75) / CAST(sum(n) AS BIGINT) * 100 AS q3,
       quantile_cont(n, 0.75) / CAST(sum(n) AS BIGINT) * 100 - quantile_cont(n, 0.25) / CAST(sum(n) AS BIGINT) * 100
         AS iqr,
       max(n) / CAST(sum(n) AS BIGINT) * 100 AS max_route
FROM rsh GROUP BY year, user_type""", _ROUTE_SHARE),
    "route_share_histogram": _route_hist(),
    "route_summary": sql("SELECT user_type, route_id, count(*) AS trip_count FROM trips GROUP BY ALL"),
    "route_ranked": sql(f"SELECT {_RANKED_COLS} FROM rk", _RANKED),
    "top10_routes": sql(f"SELECT {_RANKED_COLS} FROM rk WHERE route_rank <= {K.TOP_ROUTES}", _RANKED),
    "routes_for_50pct": sql(
        "SELECT user_type, CAST(min(route_rank) AS INTEGER) AS routes_for_50pct FROM rk "
        "WHERE CAST(cum_trips AS DOUBLE) >= 0.5 * CAST(group_trips AS DOUBLE) GROUP BY user_type", _RANKED),
    "top10_route_share": sql(
        f"SELECT user_type, sum(trip_count) / max(group_trips) AS pct_trip_top{K.TOP_ROUTES} FROM rk "
        f"WHERE route_rank <= {K.TOP_ROUTES} GROUP BY user_type", _RANKED),
    "route_kpi_summary": sql(
        "SELECT user_type, CAST(min(CASE WHEN CAST(cum_trips AS DOUBLE) >= 0.5 * CAST(group_trips AS DOUBLE) "
        "THEN route_rank END) AS INTEGER) AS routes_for_50pct, "
        f"sum(CASE WHEN route_rank <= {K.TOP_ROUTES} THEN trip_count END) / max(group_trips) "
        f"AS pct_trip_top{K.TOP_ROUTES} FROM rk GROUP BY user_type", _RANKED),
    # export
    "export_trip_2019": sql(
        f"SELECT * REPLACE (CAST(trip_id AS VARCHAR) AS trip_id), {_peak()} AS is_peak "
        f"FROM (SELECT *, CAST(2019 AS INTEGER) AS year, {_ENRICH} FROM legacy_canon) t"),
    "export_trip_2020": sql(
        f"SELECT *, {_peak()} AS is_peak FROM (SELECT *, CAST(2020 AS INTEGER) AS year, {_ENRICH} FROM modern_canon) t"),
    "bi_prepared_trips": sql(
        "SELECT * EXCLUDE (start_time, end_time, is_weekend, round_trip, is_peak), "
        "strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time, strftime(end_time, '%Y-%m-%d %H:%M:%S') AS end_time, "
        "CAST(is_weekend AS INTEGER) AS is_weekend, CAST(round_trip AS INTEGER) AS round_trip, "
        "CAST(is_peak AS INTEGER) AS is_peak FROM trips"),
    "export_route_ranked": sql("SELECT user_type, CAST(route_rank AS INTEGER) AS route_rank, "
                               "cum_trips / group_trips AS cum_trip_pct FROM rk", _RANKED),
    "export_trip_demo": sql("SELECT trip_id, user_type, age_group, age_rank, duration_sec, duration_log10 FROM demo"),
}


def _bigint_count_if(text: str) -> str:
    """Wrap every ``count_if(...)`` in ``CAST(... AS BIGINT)``: DuckDB returns
    HUGEINT for it, Spark BIGINT."""
    out, i, token = [], 0, "count_if("
    while True:
        j = text.find(token, i)
        if j < 0:
            out.append(text[i:])
            return "".join(out)
        depth, k = 0, j + len(token) - 1
        while True:
            if text[k] == "(":
                depth += 1
            elif text[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(text[i:j])
        out.append("CAST(" + _bigint_count_if(text[j:k + 1].replace(token, "\0", 1)).replace("\0", token, 1)
                   + " AS BIGINT)")
        i = k + 1


ORACLE_SQL = {name: _bigint_count_if(text) for name, text in ORACLE_SQL.items()}
