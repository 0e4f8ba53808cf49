"""Schema checks, table resolution and small Column helpers shared by operators.

Every check here reads ``df.schema`` only: no job is started before the inputs
are known to be valid.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAINS = ("day", "week", "month", "quarter", "year")
_PERIOD_RE = re.compile(r"^\d{4}-\d{2}$")


class OperatorError(ValueError):
    """Invalid input or an unmet statistical precondition."""


def field(df: DataFrame, name: str) -> T.StructField:
    for f in df.schema.fields:
        if f.name == name:
            return f
    available = ", ".join(df.columns)
    raise OperatorError(f"column '{name}' is not in the table, whose columns are {available}")


def is_numeric_type(dt: T.DataType) -> bool:
    # INTERVAL types are not numbers (deliberately unlike a substring test on "INT").
    return isinstance(dt, T.NumericType)


def is_temporal_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def require_column(df: DataFrame, name: str) -> T.StructField:
    return field(df, name)


def require_numeric(df: DataFrame, name: str) -> T.StructField:
    f = field(df, name)
    if not is_numeric_type(f.dataType):
        raise OperatorError(f"column '{name}' is {f.dataType.simpleString()} and not numeric")
    return f


def require_temporal(df: DataFrame, name: str) -> T.StructField:
    f = field(df, name)
    if not is_temporal_type(f.dataType):
        raise OperatorError(
            f"date_column '{name}' is {f.dataType.simpleString()} and no date or timestamp"
        )
    return f


def require_grain(granularity: str) -> str:
    if granularity not in GRAINS:
        raise OperatorError(f"granularity must be one of {GRAINS}, got {granularity!r}")
    return granularity


def require_period(label: str, period: str) -> str:
    if not isinstance(period, str) or not _PERIOD_RE.match(period):
        raise OperatorError(f"{label} is no month such as '2024-05': {period!r}")
    month = int(period[5:7])
    if not 1 <= month <= 12:
        raise OperatorError(f"{label} is no month such as '2024-05': {period!r}")
    return period


def month_bounds(period: str) -> tuple[str, str]:
    """Half-open [first day, first day of next month) for 'YYYY-MM'."""
    y, m = int(period[:4]), int(period[5:7])
    ny, nm = (y + 1, 1) if m == 12 else (y, m + 1)
    return f"{y:04d}-{m:02d}-01", f"{ny:04d}-{nm:02d}-01"


def month_range_filter(col: str, period: str, dtype: T.DataType) -> Column:
    """``col`` inside the month, as a plain range so Parquet can prune on it."""
    lo, hi = month_bounds(period)
    lit_lo, lit_hi = _temporal_lit(lo, dtype), _temporal_lit(hi, dtype)
    return (F.col(col) >= lit_lo) & (F.col(col) < lit_hi)


def _temporal_lit(day: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        return F.lit(day).cast("date")
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(day).cast("timestamp_ntz")
    return F.lit(day).cast("timestamp")


def truncate(col: str | Column, granularity: str, dtype: T.DataType) -> Column:
    """``date_trunc`` that keeps the column's own temporal type.

    Spark's ``date_trunc`` yields a session-zone ``timestamp``; timestamp_ntz and
    date inputs are cast back so periods compare as the source values do.
    """
    require_grain(granularity)
    c = F.col(col) if isinstance(col, str) else col
    t = F.date_trunc(granularity, c)
    if isinstance(dtype, T.TimestampNTZType):
        return t.cast("timestamp_ntz")
    if isinstance(dtype, T.DateType):
        return t.cast("date")
    return t


def timestampdiff(granularity: str, start: str, end: str) -> Column:
    unit = {"day": "DAY", "week": "WEEK", "month": "MONTH", "quarter": "QUARTER", "year": "YEAR"}[
        require_grain(granularity)
    ]
    return F.expr(f"timestampdiff({unit}, `{start}`, `{end}`)")


def resolve_table(tables: Mapping[str, DataFrame], inputs: Mapping, explicit: str | None = None) -> str:
    """Pick the table an operator runs on.

    Explicit name wins. Otherwise gather every input value that names a loaded
    column (strings, and - unlike a string-only scan - the strings inside
    lists); prefer the first (primary) table if it has them all, else the first
    table that does. No column named → primary. None has them all → error.
    """
    if not tables:
        raise OperatorError("no tables loaded")
    names = list(tables)
    if explicit is not None:
        if explicit not in tables:
            raise OperatorError(f"unknown table '{explicit}'. Available: {', '.join(names)}")
        return explicit
    all_cols = {c for df in tables.values() for c in df.columns}
    wanted: list[str] = []
    for v in inputs.values():
        vals = v if isinstance(v, (list, tuple)) else [v]
        for x in vals:
            if isinstance(x, str) and x in all_cols and x not in wanted:
                wanted.append(x)
    if not wanted:
        return names[0]
    for n in names:
        if set(wanted) <= set(tables[n].columns):
            return n
    raise OperatorError(f"no single table has all of {wanted}")


def listwise(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Listwise deletion: keep rows where every named column is non-null."""
    cols = list(cols)
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df.select(*cols).where(cond) if cond is not None else df
