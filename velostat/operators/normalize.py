"""Bring the two source shapes to one canonical trip schema.

Canonical columns (both shapes)::

    trip_id, start_time, end_time, start_station_id, start_station_name,
    end_station_id, end_station_name, user_type, duration_sec

plus ``bike_id, gender, birth`` (legacy) and ``start_lat, start_lng,
end_lat, end_lng`` (modern).  All operators are single projections or
filters, so they fuse into the scan's whole-stage-codegen stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velostat import constants as K
from velostat.functions import elapsed

LEGACY_CANONICAL = (
    "trip_id", "start_time", "end_time", "bike_id", "start_station_id", "start_station_name",
    "end_station_id", "end_station_name", "user_type", "gender", "birth", "duration_sec",
)
MODERN_CANONICAL = (
    "trip_id", "start_time", "end_time", "start_station_id", "start_station_name",
    "end_station_id", "end_station_name", "start_lat", "start_lng", "end_lat", "end_lng",
    "user_type", "duration_sec",
)


def repair_duration(
    df: DataFrame, column: str = "tripduration", start: str = "start_time", end: str = "end_time",
    unit: str = "SECOND",
) -> DataFrame:
    """Replace ``column`` by the whole ``unit``s elapsed from ``start`` to ``end``.

    Same as ``SELECT * EXCEPT (column), timestamp_diff(end, start, unit) AS column``:
    the repaired column moves to the end.
    """
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, elapsed(unit, start, end).alias(column))


def recode_user_type(
    df: DataFrame, column: str = "user_type", mapping: Mapping[str, str] = K.USER_TYPE_RECODE,
    source_column: str | None = None,
) -> DataFrame:
    """Map source labels to canonical ones; unmapped values (and NULL) become NULL.

    With ``source_column`` set, the original label is kept under that name.
    """
    c = F.col(column)
    expr = None
    for src, dst in mapping.items():
        expr = F.when(c == src, F.lit(dst)) if expr is None else expr.when(c == src, F.lit(dst))
    if source_column:
        df = df.withColumn(source_column, c)
    return df.withColumn(column, expr)


def normalize_legacy(df: DataFrame, recode: bool = True) -> DataFrame:
    """Legacy shape → canonical: duration repaired in seconds, renamed, user type recoded."""
    out = repair_duration(df).withColumnsRenamed(dict(K.LEGACY_RENAMES))
    out = out.withColumn("birth", F.col("birth").cast("int"))
    if recode:
        out = recode_user_type(out)
    return out.select(*LEGACY_CANONICAL)


def valid_trips(
    df: DataFrame, start: str = "started_at", end: str = "ended_at", end_station: str = "end_station_id"
) -> DataFrame:
    """Keep trips that end after they start and have a destination."""
    return df.where((F.col(start) < F.col(end)) & F.col(end_station).isNotNull())


def normalize_modern(df: DataFrame, valid_only: bool = True) -> DataFrame:
    """Modern shape → canonical: (valid trips only,) duration in whole seconds,
    constant column dropped, renamed."""
    if valid_only:
        df = valid_trips(df)
    out = df.withColumn("duration_sec", elapsed("SECOND", "started_at", "ended_at"))
    out = out.drop(*K.MODERN_DROPPED).withColumnsRenamed(dict(K.MODERN_RENAMES))
    return out.select(*MODERN_CANONICAL)


def demographic_trips(df: DataFrame, as_of_year: int = K.AS_OF_YEAR) -> DataFrame:
    """Trips whose rider has both gender and birth year, with ``age`` added."""
    return df.where(F.col("gender").isNotNull() & F.col("birth").isNotNull()).withColumn(
        "age", (F.lit(as_of_year) - F.col("birth")).cast("int")
    )


def with_year(df: DataFrame, year: int) -> DataFrame:
    """Tag a source with its year and make ``trip_id`` text, before any union.

    The cast must precede the union: stacking a numeric id with an
    alphanumeric one would otherwise widen to a number and fail.
    """
    return df.withColumn("trip_id", F.col("trip_id").cast("string")).withColumn(
        "year", F.lit(year).cast("int")
    )


def common_columns(dfs: Sequence[DataFrame]) -> list[str]:
    """Columns present in every frame, in the order of the first."""
    first, *rest = dfs
    others = [set(d.columns) for d in rest]
    return [c for c in first.columns if all(c in o for o in others)]


_WIDER = (
    (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()),
    (T.FloatType(), T.DoubleType()),
)


def common_types(
    dfs: Sequence[DataFrame], types: Mapping[str, str | T.DataType] | None = None,
) -> dict[str, T.DataType]:
    """The type of every common column after stacking ``dfs``.

    A declared type (``types``) stands.  Without one, equal types stay, and
    whole numbers, or floats, of different widths take the widest: no value
    changes.  Any other difference raises ``TypeError`` with the column and
    each source's type: what a number and a text are to become is for the
    caller to declare, not for an implicit cast to decide.
    """
    names = common_columns(dfs)
    declared = {c: T._parse_datatype_string(t) if isinstance(t, str) else t for c, t in (types or {}).items()}
    if unknown := sorted(set(declared) - set(names)):
        raise ValueError(f"types declared for columns that are not common: {', '.join(unknown)}")
    out = {}
    for c in names:
        found = [d.schema[c].dataType for d in dfs]
        if c in declared:
            out[c] = declared[c]
        elif all(t == found[0] for t in found):
            out[c] = found[0]
        else:
            widths = next((w for w in _WIDER if all(t in w for t in found)), None)
            if widths is None:
                raise TypeError(f"column {c!r} differs between sources: {', '.join(t.simpleString() for t in found)}; "
                                "declare its type")
            out[c] = max(found, key=widths.index)
    return out


def union_common(*dfs: DataFrame, types: Mapping[str, str | T.DataType] | None = None) -> DataFrame:
    """UNION ALL by name over the common columns (schema-level intersection),
    each cast to its type of :func:`common_types`."""
    kinds = common_types(dfs, types)
    casts = [[F.col(f"`{c}`").cast(t).alias(c) if d.schema[c].dataType != t else F.col(f"`{c}`")
              for c, t in kinds.items()] for d in dfs]
    out = dfs[0].select(*casts[0])
    for d, cols in zip(dfs[1:], casts[1:]):
        out = out.unionByName(d.select(*cols))
    return out
