"""Values at given positions of an order, without sorting.

Selection by histogram refinement: rows are counted in buckets between the smallest
and the largest value (a map-side combined aggregation of a bounded number of rows a
task), the bucket that holds a wanted position becomes the next interval, and only
rows inside it are counted again. Each bucket also returns its own smallest and
largest value, so the first and last position of a bucket, and buckets of a single
value, are answered at once. Numbers are divided into ``BUCKETS`` equal parts, on a
linear scale and on a logarithmic one in turn (so values of very different sizes
come apart, too); texts by the character after the bounds' common prefix. A pass
divides an interval by some thousands: two or three passes over the rows of a
column, no sorted copy, no shuffle of rows.

Any number of groups is selected from at the same time; a group with a third of all
rows is counted by all tasks. Nulls come last, NaN before them, as in an ascending
Spark order with nulls last.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed

BUCKETS = 4096
FEW = 10_000  # rows of a few numbers that may be held by the driver between passes
_EXACT = float(1 << 61)  # differences of longs below it do not overflow


def _measure(c: Column, dtype: T.DataType) -> tuple[Column, str]:
    """A column in the type that buckets are computed in: double, long, decimal or string."""
    if isinstance(dtype, T.StringType):
        return c, "string"
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("long"), "long"
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c), "long"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.cast("double"), "double"
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return c.cast("long"), "long"
    if isinstance(dtype, T.DecimalType):
        return c, "decimal"
    raise ValueError(f"cannot select by a column of type {dtype.simpleString()}")


def _share(kind: str) -> str:
    """Where _v lies between _lo and _hi, from 0 to 1: never less for a larger value."""
    if kind == "decimal":
        return "double(_v - _lo) / double(_hi - _lo)"
    if kind == "long":
        far = "(double(_v) / 2 - double(_lo) / 2) / (double(_hi) / 2 - double(_lo) / 2)"
        return f"CASE WHEN abs(double(_hi) / 2 - double(_lo) / 2) < {_EXACT / 2} THEN double(_v - _lo) / double(_hi - _lo) ELSE {far} END"
    return "CASE WHEN abs(_lo) > 1e300 OR abs(_hi) > 1e300 THEN (_v / 2 - _lo / 2) / (_hi / 2 - _lo / 2) ELSE (_v - _lo) / (_hi - _lo) END"


def _log_scale(c: str) -> str:
    """From the smallest to the largest double some 1420 either way: a bucket spans a factor of two."""
    return f"signum({c}) * (ln(greatest(abs({c}), 1e-308D)) + 709.2D)"


def _bucket(kind: str, logarithmic: bool) -> str:
    """Bucket of a value _v of the interval [_lo, _hi]; -1 and BUCKETS up for infinities,
    NaN and null. For texts, the character after the bounds' common prefix."""
    if kind == "string":
        places = "sequence(1, greatest(1, least(length(_lo), length(_hi))))"
        return f"substring(_v, size(filter({places}, i -> substring(_lo, 1, i) = substring(_hi, 1, i))) + 1, 1)"
    if kind == "double" and logarithmic:
        v, lo, hi = (_log_scale(c) for c in ("_v", "_lo", "_hi"))
        at = f"CASE WHEN {hi} > {lo} THEN ({v} - {lo}) / ({hi} - {lo}) END"
    else:
        at = f"CASE WHEN _hi > _lo THEN {_share(kind)} END"
    inside = f"least({BUCKETS - 1}, floor(coalesce({at}, 0D) * {BUCKETS}))"
    special = f"WHEN _v IS NULL THEN {BUCKETS + 2}"
    if kind == "double":
        special += f" WHEN isnan(_v) THEN {BUCKETS + 1} WHEN _v = double('inf') THEN {BUCKETS} WHEN _v = double('-inf') THEN -1"
    return f"CASE {special} ELSE {inside} END"


def _same(by: Sequence[str], prefix: str) -> Column:
    conds = [F.col(b).eqNullSafe(F.col(f"{prefix}{i}")) for i, b in enumerate(by)]
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def _renamed(df: DataFrame, by: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({b: f"{prefix}{i}" for i, b in enumerate(by)})


def bounds(column: Column, dtype: T.DataType) -> list[Column]:
    """Aggregates for the first interval of ``value_at``: smallest and largest finite
    value, named ``_lo`` and ``_hi``."""
    v, kind = _measure(column, dtype)
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v) if kind == "double" else v
    return [F.min(finite).alias("_lo"), F.max(finite).alias("_hi")]


class Held:
    """A result that is read several times, and how many of its rows are ``open``: held
    by the driver where it has ``FEW`` rows at most, else written."""

    def __init__(self, df: DataFrame, open_rows: str | None = None, few: bool | None = None):
        spark = df.sparkSession
        table = df.toArrow() if few else df.limit(FEW + 1).toArrow() if few is None else None
        self.few = table is not None and table.num_rows <= FEW
        self.df = spark.createDataFrame(table, df.schema) if self.few else checkpointed(df)
        if self.few:
            self.open = table.num_rows if open_rows is None else pc.sum(table[open_rows].cast("int64")).as_py() or 0
        else:
            self.open = self.df.where(open_rows or "true").count()


def value_at(
    df: DataFrame, by: Sequence[str], column: str, targets: DataFrame, ends: DataFrame | None = None, ties: bool = False
) -> DataFrame:
    """(by, pid, ``column``, rel) for the ``targets`` (by, pid, pos): the value at
    position ``pos`` (from 0) of its group's ascending order. ``pid`` tells a group's
    targets apart. Positions beyond a group give no row. With ``ties``, ``rel`` is the
    position among the rows of the group with that very value. ``ends``: the groups'
    (by, _lo, _hi) as of ``bounds``, if they are known."""
    by = list(by)
    quoted = [f"`{b}`" for b in by]
    dtype = df.schema[column].dataType
    measured, kind = _measure(F.col(column), dtype)
    rows = df.select(*by, measured.alias("_v"), F.col(column).alias("_c"))
    if ends is None:
        groups = _renamed(targets.select(*by).distinct(), by, "_t")
        wanted = df.join(groups, _same(by, "_t"), "left_semi") if by else df
        ends = wanted.groupBy(*by).agg(*bounds(F.col(column), dtype))
    first = _renamed(ends.select(*by, "_lo", "_hi"), by, "_e").join(targets.withColumnRenamed("pos", "rel"), _same(by, "_e"))
    held = Held(first.select(*by, "pid", "rel", "_lo", "_hi"))
    pending = held.df
    found, turn = [pending.limit(0).select(*by, "pid", F.lit(None).cast(dtype).alias(column), "rel")], 0
    while held.open:
        state = _renamed(pending.select(*by, "_lo", "_hi").distinct(), by, "_t")
        inside = F.expr("_v BETWEEN _lo AND _hi") if turn else F.lit(True)
        # a group has at most as many intervals as targets; without groups they are all there are
        cells = rows.join(state if by else F.broadcast(state), _same(by, "_t") & inside if by else inside)
        cells = cells.groupBy(*by, "_lo", F.expr(_bucket(kind, bool(turn % 2))).alias("_b")).agg(
            *map(F.expr, ("count(1) AS _n", "min(_v) AS _least", "max(_v) AS _most", "min(_c) AS _first", "max(_c) AS _last"))
        )
        order = Window.partitionBy(*by, "_lo").orderBy(F.asc_nulls_last("_b"))  # of the buckets of one interval
        cells = _renamed(cells.withColumn("_end", F.sum("_n").over(order)), by, "_t").withColumnRenamed("_lo", "_of")
        at = F.expr("_lo <=> _of AND rel >= _end - _n AND rel < _end")
        hit = pending.join(F.broadcast(cells) if not by else cells, _same(by, "_t") & at if by else at)
        hit = hit.selectExpr(*quoted, "pid", "rel - (_end - _n) AS rel", "_n", "_least", "_most", "_first", "_last")
        more = "NOT (_least <=> _most OR rel = 0" + (")" if ties else " OR rel = _n - 1)")
        # a row for a target at most
        held = Held(hit.selectExpr("*", f"{more} AS _open"), "_open", held.few)
        value = f"CASE WHEN rel = 0 OR _least <=> _most THEN _first ELSE _last END AS `{column}`"
        found.append(held.df.where("NOT _open").selectExpr(*quoted, "pid", value, "rel"))
        pending = held.df.where("_open").selectExpr(*quoted, "pid", "rel", "_least AS _lo", "_most AS _hi")
        turn += 1
    return reduce(DataFrame.unionByName, found)
