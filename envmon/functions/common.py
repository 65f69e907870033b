"""Column helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def as_date(value) -> Column:
    """A DATE literal from a date, a 'YYYY-MM-DD' string or a Column."""
    if isinstance(value, Column):
        return value.cast("date")
    if value is None:
        return F.current_date()
    if isinstance(value, (_dt.date, _dt.datetime)):
        value = value.strftime("%Y-%m-%d")
    return F.lit(value).cast("date")


def since_bound(as_of, days: int) -> Column:
    """Midnight ``days`` before ``as_of`` as a zone-less timestamp."""
    return F.date_sub(as_date(as_of), int(days)).cast("timestamp_ntz")


def since(col: str | Column, as_of, days: int) -> Column:
    """``col >= as_of - days`` with the bound at midnight, inclusive.

    This is the "last N days" rule of every statistics call: lower bound only,
    at the start of the day.
    """
    c = F.col(col) if isinstance(col, str) else col
    return c >= since_bound(as_of, days)


# Text equality like the source database's default collation (case and accents ignored);
# opt-in, binary equality is the default.
CI_AI = "UNICODE_CI_AI"


def text_equals(col: str | Column, value: str, collation: str | None = None) -> Column:
    """``col = value``, optionally under a collation such as ``CI_AI``."""
    c = F.col(col) if isinstance(col, str) else col
    if collation is None:
        return c == F.lit(value)
    return F.collate(c, collation) == F.lit(value)


def text_keys(df: DataFrame, columns, collation: str | None) -> dict[str, Column]:
    """The key columns by name, text ones under ``collation`` (None: as they are)."""
    kinds = dict(df.dtypes)
    return {c: F.collate(F.col(c), collation) if collation is not None and kinds[c].startswith("string") else F.col(c) for c in columns}


def apply_filters(df: DataFrame, filters: Mapping[str, object] | None, collation: str | None = None) -> DataFrame:
    """Equality filters joined by AND; a None value means no filter.

    ``collation`` applies to text values (e.g. ``CI_AI`` for case- and accent-blind names).
    """
    for col, value in (filters or {}).items():
        if value is None:
            continue
        if isinstance(value, (list, tuple, set, frozenset)):
            df = df.filter(F.col(col).isin(list(value)))
        elif isinstance(value, str):
            df = df.filter(text_equals(col, value, collation))
        else:
            df = df.filter(F.col(col) == F.lit(value))
    return df


def contains_ci(col: str, text: str | None) -> Column:
    """``col LIKE '%text%'`` ignoring case (the source collation ignores case)."""
    if text is None:
        return F.lit(True)
    pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return F.col(col).ilike(pattern)


def mean_of(sum_col: str | Column, count_col: str | Column) -> Column:
    """Mean from pre-aggregated sum and count columns."""
    s = F.col(sum_col) if isinstance(sum_col, str) else sum_col
    n = F.col(count_col) if isinstance(count_col, str) else count_col
    return s.cast("double") / F.nullif(n, F.lit(0))


def count_if(cond: Column) -> Column:
    """Number of rows where ``cond`` holds, as BIGINT (0 when none)."""
    return F.coalesce(F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("bigint")


# Fact tables written by this package are partitioned by the day of their time column
# (<time column> -> <partition column>).  Time filters add the matching day predicate so
# the scan prunes whole partitions instead of reading every file.
DAY_PARTITIONS = {"collected_at": "collected_date"}


def with_day_pruning(df: DataFrame, ts_col: str, lo=None, hi=None) -> DataFrame:
    """Add ``lo <= day(ts_col) <= hi`` on the day partition column, when the frame has one.

    ``lo`` / ``hi`` are Columns or values of the timestamp bounds already applied to
    ``ts_col``; the day predicate is implied by them, so results do not change.
    """
    part = DAY_PARTITIONS.get(ts_col)
    if part is None or part not in df.columns:
        return df
    if lo is not None:
        lo_c = lo if isinstance(lo, Column) else F.lit(lo)
        df = df.filter(F.col(part) >= F.to_date(lo_c.cast("timestamp_ntz")))
    if hi is not None:
        hi_c = hi if isinstance(hi, Column) else F.lit(hi)
        df = df.filter(F.col(part) <= F.to_date(hi_c.cast("timestamp_ntz")))
    return df
