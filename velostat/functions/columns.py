"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def elapsed(unit: str, start: str | Column, end: str | Column) -> Column:
    """Whole elapsed ``unit``s from ``start`` to ``end`` (truncated toward zero).

    Matches a warehouse ``timestamp_diff``: 0.2 s across a second edge is 0.
    """
    return F.timestamp_diff(unit, col(start), col(end))


def elapsed_minutes(start: str | Column, end: str | Column) -> Column:
    """Fractional minutes between two timestamps, as DOUBLE (``difftime`` in minutes)."""
    micros = F.timestamp_diff("MICROSECOND", col(start), col(end))
    return micros.cast("double") / F.lit(60_000_000.0)


def add_seconds(ts: str | Column, seconds: str | Column) -> Column:
    return F.timestamp_add("SECOND", col(seconds), col(ts))


def null_safe_key(*cols: str | Column, sep: str = "_") -> Column:
    """Concatenate ids as text; a NULL id is written ``NA`` (not skipped)."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.coalesce(col(c).cast("string"), F.lit("NA")))
    return F.concat(*parts)


def weekday_label(ts: str | Column) -> Column:
    """Three-letter weekday, week starting Sunday (``Sun`` .. ``Sat``)."""
    return F.date_format(col(ts), "E")


def weekday_number(ts: str | Column) -> Column:
    """1 = Sunday .. 7 = Saturday (sort key for :func:`weekday_label`)."""
    return F.dayofweek(col(ts))


def in_hour_windows(hour: str | Column, windows: Sequence[tuple[int, int]]) -> Column:
    """TRUE when ``hour`` falls in any inclusive ``(first, last)`` window."""
    h = col(hour)
    cond = None
    for lo, hi in windows:
        part = h.between(lo, hi)
        cond = part if cond is None else (cond | part)
    return cond if cond is not None else F.lit(False)  # an unknown hour stays unknown


def _fmt(v) -> str:
    return "Inf" if v is None else str(v)


def cut(value: str | Column, breaks: Sequence[int | None]) -> tuple[Column, Column]:
    """Left-closed binning ``[a, b)`` over ``breaks``; returns (label, rank).

    ``None`` as the last break means an open upper end (label ``[a,Inf)``).
    Values outside every bin (and NULL) get NULL label and NULL rank.
    """
    v = col(value)
    label = None
    rank = None
    for i in range(len(breaks) - 1):
        lo, hi = breaks[i], breaks[i + 1]
        cond = (v >= lo) if hi is None else ((v >= lo) & (v < hi))
        text = f"[{_fmt(lo)},{_fmt(hi)})"
        label = F.when(cond, F.lit(text)) if label is None else label.when(cond, F.lit(text))
        rank = F.when(cond, F.lit(i + 1)) if rank is None else rank.when(cond, F.lit(i + 1))
    return label, rank


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as DOUBLE; NULL when den is 0 (ANSI mode would raise)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def round_half_even(c: str | Column, digits: int = 2) -> Column:
    return F.bround(col(c), digits)


def bisect_left(edges: str | Column, x: str | Column, max_edges: int) -> Column:
    """How many of the sorted ``edges`` (an array of at most ``max_edges``
    values) are below ``x``: a binary search inside the row, NULL if either is.
    """
    e, v = col(edges), col(x)
    return _bisect(e, max_edges, lambda edge: edge < v)


def bisect_right(edges: str | Column, x: str | Column, max_edges: int) -> Column:
    """How many of the sorted ``edges`` are at most ``x``."""
    e, v = col(edges), col(x)
    return _bisect(e, max_edges, lambda edge: edge <= v)


def _bisect(edges: Column, max_edges: int, before) -> Column:
    steps = F.array(*[F.lit(1 << k) for k in range(max(max_edges, 1).bit_length() - 1, -1, -1)])
    # F.get is NULL beyond the end, and a NULL condition takes no step
    found = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(before(F.get(edges, at + step - 1)), at + step).otherwise(at))
    return F.when(F.size(edges) == 0, F.lit(0)).when(before(F.get(edges, F.lit(0))).isNotNull(), found)
