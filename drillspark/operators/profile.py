"""Profiling and default analysis.

``profile`` computes every column's statistics in one wide aggregation plus
one pass over the unpivoted (column, value) pairs for exact distinct counts
and samples - instead of one query per column and statistic, and without the
row explosion many ``count(DISTINCT)`` in one aggregate would cause.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_numeric_type, is_temporal_type, require_column, truncate
from ..functions.numeric import dround
from .change import decompose_contribution, volume_vs_rate

SAMPLES = 5

# Name hints of the default analysis.
MEASURE_HINTS = ("revenue", "sales", "amount", "total", "profit", "value")
DIMENSION_HINTS = ("segment", "region", "product", "category", "channel", "country")


def _orderable(dt: T.DataType) -> bool:
    variant = getattr(T, "VariantType", None)
    if isinstance(dt, T.MapType) or (variant is not None and isinstance(dt, variant)):
        return False
    if isinstance(dt, (T.ArrayType,)):
        return _orderable(dt.elementType)
    if isinstance(dt, T.StructType):
        return all(_orderable(f.dataType) for f in dt.fields)
    return True


def _as_text(f: T.StructField) -> Column:
    """A column's values as text; -0.0 is the same value as 0.0."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        c = F.when(c == 0, F.lit(0.0).cast(f.dataType)).otherwise(c)
    return c.cast("string")


def _unpivoted(df: DataFrame) -> DataFrame:
    """(ordinal, value) of every non-null cell, values as text."""
    cells = [F.struct(F.lit(i).alias("ordinal"), _as_text(f).alias("value")) for i, f in enumerate(df.schema.fields)]
    return df.select(F.explode(F.array(*cells)).alias("p")).select("p.ordinal", "p.value").where(F.col("value").isNotNull())


def _ends(f: T.StructField, c: Column) -> list[Column]:
    return [F.min(c), F.max(c)] if _orderable(f.dataType) else [F.lit(None), F.lit(None)]


def _per_column(df: DataFrame, extra: Callable[[T.StructField, Column], dict[str, Column]] | None = None) -> DataFrame:
    """One row a column from one wide aggregation: ordinal, column, dtype, row_count,
    non_null, min and max as text, and the ``extra`` aggregates."""
    fields = df.schema.fields
    if not fields:
        raise ValueError("table has no columns")
    aggs, cells = [F.count(F.lit(1)).alias("_rows")], []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        low, high = (e.cast("string") for e in _ends(f, c))
        made = {"non_null": F.count(c), "min": low, "max": high} | (extra(f, c) if extra else {})
        aggs += [a.alias(f"_{n}{i}") for n, a in made.items()]
        head = [F.lit(i).alias("ordinal"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype")]
        cells.append(F.struct(*head, F.col("_rows").alias("row_count"), *[F.col(f"_{n}{i}").alias(n) for n in made]))
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _null_fraction() -> Column:
    share = dround((F.col("row_count") - F.col("non_null")) / F.col("row_count"), 4)
    return F.when(F.col("row_count") == 0, F.lit(0.0)).otherwise(share).alias("null_fraction")


def profile(df: DataFrame, approx: bool = False, samples: int = SAMPLES) -> DataFrame:
    """One row per column: ordinal, column, dtype, row_count, null_fraction
    (4 dp; 0 for an empty table), distinct_count, min and max as text (null
    for unorderable types) and up to ``samples`` distinct non-null values as
    text.

    Exact: one wide aggregation, and one shuffle of the distinct (column,
    value) pairs that serves both the distinct counts and the samples, which
    are the smallest values by text (each task keeps its ``samples`` smallest).
    ``approx``: the wide aggregation alone, by sketches (see ``profile_of``);
    without samples."""
    if approx:
        out = profile_of(sketch_profile(df)).drop("quantiles")
        return out.withColumn("sample_values", F.array().cast("array<string>"))
    stats = _per_column(df)
    pairs = _unpivoted(df).distinct()
    smallest = Window.partitionBy("ordinal").orderBy("value")
    picked = (
        pairs.withColumn("_k", F.row_number().over(smallest))
        .where(F.col("_k") <= samples)
        .groupBy("ordinal")
        .agg(F.sort_array(F.collect_list("value")).alias("sample_values"))
    )
    counts = pairs.groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct_count"))
    out = stats.join(picked, "ordinal", "left").join(counts, "ordinal", "left")
    return out.select(
        "ordinal",
        "column",
        "dtype",
        "row_count",
        _null_fraction(),
        F.coalesce(F.col("distinct_count"), F.lit(0)).cast("long").alias("distinct_count"),
        "min",
        "max",
        F.coalesce(F.col("sample_values"), F.array().cast("array<string>")).alias("sample_values"),
    ).orderBy("ordinal")


HLL_LOG_K = 14  # registers of a distinct-count sketch, as a power of two: standard error under 1 %
KLL_K = 400  # of a quantile sketch: rank error under 0.7 %, with 99 % confidence
QUARTILES = (0.25, 0.5, 0.75)


def sketch_profile(df: DataFrame) -> DataFrame:
    """What a profile needs of a table, in a form that adds up: one row a column with
    counts, ends and sketches (distinct values; quantiles of numeric columns). Stored
    beside a snapshot, a day's sketches are merged with earlier ones
    (``merge_sketches``) instead of reading everything again."""

    def sketches(f: T.StructField, c: Column) -> dict[str, Column]:
        number = c.cast("double")
        usable = F.when(~F.isnan(number), number) if is_numeric_type(f.dataType) else F.lit(None).cast("double")
        return {"hll": F.hll_sketch_agg(_as_text(f), HLL_LOG_K), "kll": F.kll_sketch_agg_double(usable, KLL_K)}

    return _per_column(df, sketches)


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """The sketches of several parts of one table as those of the whole. Parts must have
    the same columns in the same order."""
    both = reduce(DataFrame.unionByName, parts)
    # ends are text: numbers are ordered as numbers, other types (ISO dates, text) as they are
    numeric = F.col("dtype").rlike(r"^(tinyint|smallint|int|bigint|float|double|decimal\(.*)$")
    key = lambda c: F.struct(F.when(numeric, F.expr(f"try_cast({c} AS double)")), F.when(numeric, F.expr(f"try_cast({c} AS decimal(38,9))")), F.col(c))
    known = lambda c: F.when(F.col(c).isNotNull(), key(c))
    return both.groupBy("ordinal", "column", "dtype").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("non_null").alias("non_null"),
        F.min_by("min", known("min")).alias("min"),
        F.max_by("max", known("max")).alias("max"),
        F.hll_union_agg("hll").alias("hll"),
        F.kll_merge_agg_double("kll").alias("kll"),
    )


def profile_of(sketches: DataFrame, probs: Sequence[float] = QUARTILES) -> DataFrame:
    """The profile that sketches hold: counts, null fraction and ends are exact,
    ``distinct_count`` is an estimate (standard error under 1 %), and ``quantiles`` are
    values whose rank is within 0.7 % of the asked-for one (null for columns that
    are not numeric or have no values)."""
    at = F.array(*[F.lit(float(p)) for p in probs])
    some = F.kll_sketch_get_n_double("kll") > 0
    return sketches.select(
        "ordinal",
        "column",
        "dtype",
        "row_count",
        _null_fraction(),
        F.when(F.col("non_null") == 0, 0).otherwise(F.hll_sketch_estimate("hll")).cast("long").alias("distinct_count"),
        "min",
        "max",
        F.when(some, F.kll_sketch_get_quantile_double("kll", at)).alias("quantiles"),
    ).orderBy("ordinal")


_ID = re.compile(r"(^|_)id($|_)")


def _is_id(name: str) -> bool:
    low = name.lower()
    return bool(_ID.search(low)) or low.endswith("id")


class Roles(NamedTuple):
    date: str | None
    measure: str | None
    dimension: str | None


def column_roles(
    df: DataFrame,
    distinct_counts: dict[str, int] | None = None,
    row_count: int | None = None,
    date: str | None = None,
    measure: str | None = None,
    dimension: str | None = None,
) -> Roles:
    """Date, measure and dimension columns the default analysis uses.

    date: first temporal column, else first whose name contains "date".
    measure: numeric, not an id (name has an '_id'/'id' part or ends in
    "id"), preferring names with a measure hint, else the first such column.
    dimension: first name with a dimension hint, else the first non-numeric,
    non-id column with at most max(1, rows/4) distinct values (needs the
    profile's counts; without them this fallback is skipped).
    Schema-only unless the fallback is needed. Any role can be given
    explicitly (keys such as ``o_orderkey`` are not caught by the id rule).
    """
    fields = df.schema.fields
    for given in (date, measure, dimension):
        if given is not None:
            require_column(df, given)
    if date is None:
        date = next((f.name for f in fields if is_temporal_type(f.dataType)), None)
    if date is None:
        date = next((f.name for f in fields if "date" in f.name.lower()), None)
    numeric = [f.name for f in fields if is_numeric_type(f.dataType) and not _is_id(f.name)]
    if measure is None:
        measure = next((n for n in numeric if any(h in n.lower() for h in MEASURE_HINTS)), numeric[0] if numeric else None)
    if dimension is None:
        dimension = next((f.name for f in fields if any(h in f.name.lower() for h in DIMENSION_HINTS)), None)
    if dimension is None and distinct_counts is not None and row_count is not None:
        for f in fields:
            if (
                not _is_id(f.name)
                and not is_numeric_type(f.dataType)
                and distinct_counts.get(f.name, 0) <= max(1, row_count // 4)
            ):
                dimension = f.name
                break
    return Roles(date, measure, dimension)


def roles_from_profile(prof: DataFrame, df: DataFrame) -> Roles:
    """``column_roles`` using a profile's distinct counts (a handful of rows)."""
    rows = prof.select("column", "distinct_count", "row_count").collect()
    counts = {r["column"]: int(r["distinct_count"]) for r in rows}
    n = int(rows[0]["row_count"]) if rows else 0
    return column_roles(df, counts, n)


def auto_summary(df: DataFrame, roles: Roles | None = None, preview_rows: int | None = None) -> DataFrame:
    """The default headline query: date and measure -> the measure's monthly
    ROUND(SUM, 2); measure only -> its sum per dimension, largest first;
    otherwise the rows themselves (``preview_rows`` of them, if given)."""
    roles = roles or column_roles(df)
    if roles.date and roles.measure:
        dt = df.schema[roles.date].dataType
        slug = re.sub(r"[^a-z0-9]+", "_", roles.measure.lower()).strip("_") or "value"
        return (
            df.where(F.col(roles.date).isNotNull())
            .groupBy(truncate(roles.date, "month", dt).alias("month"))
            .agg(dround(F.sum(F.col(roles.measure).cast("double")), 2).alias(f"total_{slug}"))
            .orderBy("month")
        )
    if roles.measure:
        dim = roles.dimension or df.columns[0]
        slug = re.sub(r"[^a-z0-9]+", "_", roles.measure.lower()).strip("_") or "value"
        return (
            df.groupBy(dim)
            .agg(dround(F.sum(F.col(roles.measure).cast("double")), 2).alias(f"total_{slug}"))
            .orderBy(F.col(f"total_{slug}").desc_nulls_last())
        )
    return df if preview_rows is None else df.limit(preview_rows)


def series_extremes(df: DataFrame, label: str, value: str) -> DataFrame:
    """Low, high and last point of a (label, value) series, ordered by label,
    and the swing (high - low) / |high| * 100 (null when high is 0). Ties go
    to the earliest label. Over the whole result, one aggregation."""
    require_column(df, label)
    require_column(df, value)
    v = F.col(value).cast("double")
    lab = F.col(label)
    pts = df.where(v.isNotNull())
    s = pts.agg(
        F.min_by(F.struct(lab.cast("string").alias("l"), v.alias("v")), F.struct(v, lab)).alias("low"),
        F.min_by(F.struct(lab.cast("string").alias("l"), v.alias("v")), F.struct(-v, lab)).alias("high"),
        F.max_by(F.struct(lab.cast("string").alias("l"), v.alias("v")), lab).alias("last"),
    )
    return s.select(
        F.col("low.l").alias("low_label"),
        F.col("low.v").alias("low_value"),
        F.col("high.l").alias("high_label"),
        F.col("high.v").alias("high_value"),
        F.col("last.l").alias("last_label"),
        F.col("last.v").alias("last_value"),
        F.when(F.col("high.v") == 0, F.lit(None).cast("double"))
        .otherwise((F.col("high.v") - F.col("low.v")) / F.abs(F.col("high.v")) * F.lit(100.0))
        .alias("swing_pct"),
    )


class Drilldown(NamedTuple):
    decompositions: DataFrame | None  # dimension, value, period_a, period_b, delta, contribution_pct
    volume_rate: DataFrame | None


def auto_drilldown(
    df: DataFrame, period_a: str, period_b: str, roles: Roles | None = None, max_dimensions: int | None = None
) -> Drilldown:
    """The default follow-ups, run: decompose the change by every column
    whose name carries a dimension hint (the first ``max_dimensions``, if
    given), and split it into volume and rate."""
    roles = roles or column_roles(df)
    dims = [f.name for f in df.schema.fields if any(h in f.name.lower() for h in DIMENSION_HINTS)][:max_dimensions]
    decs = None
    if roles.date and roles.measure:
        for d in dims:
            t = decompose_contribution(df, d, roles.measure, roles.date, period_a, period_b).table
            t = t.select(F.lit(d).alias("dimension"), *t.columns)
            decs = t if decs is None else decs.unionByName(t)
    vr = None
    if roles.date and roles.measure:
        vr = volume_vs_rate(df, roles.measure, roles.date, period_a, period_b)
    return Drilldown(decs, vr)


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Equal-width bins between the column's min and max (last bin closed),
    with empty bins kept. Default bin count min(20, max(5, n // 2 or 5)).
    One aggregation for n/min/max, one for the counts; the bin list is at
    most ``bins`` rows."""
    require_column(df, column)
    x = F.col(column).cast("double")
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull())
    s = vals.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    if bins is None:
        half = F.floor(F.col("n") / 2)
        k = F.least(F.lit(20), F.greatest(F.lit(5), F.when(half == 0, F.lit(5)).otherwise(half))).cast("int")
    else:
        k = F.lit(int(bins))
    s = s.withColumn("k", k)
    width = (F.col("hi") - F.col("lo")) / F.col("k")
    b = (
        F.when(F.col("hi") == F.col("lo"), F.floor(F.col("k") / 2) + 1)
        .otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("k")) + 1, F.col("k")))
        .cast("int")
    )
    counts = vals.crossJoin(F.broadcast(s)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = s.where(F.col("n") > 0).select(
        F.explode(F.sequence(F.lit(1), F.col("k"))).alias("bin"), "lo", "hi", "k"
    )
    return (
        grid.join(counts, "bin", "left")
        .select(
            "bin",
            (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
            F.when(F.col("bin") == F.col("k"), F.col("hi")).otherwise(F.col("lo") + F.col("bin") * width).alias("bin_hi"),
            F.coalesce(F.col("count"), F.lit(0)).alias("count"),
        )
        .orderBy("bin")
    )
