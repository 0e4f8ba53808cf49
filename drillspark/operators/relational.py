"""Relational building blocks the free-form SQL of an investigation uses
beyond plain select/filter/join/group: as-of lookups against a list of
cut-offs, running totals at cut-offs (a range join), membership flags and
skew-proof ordered windows.

The cut-off list is a caller-given literal (its size is the parameter, not
the data), so it is always safe to broadcast. Rows are assigned to the
interval between consecutive cut-offs once (a binary search over the sorted
list), which replaces the row-times-cut-offs expansion a ``date <= cutoff``
join would do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import require_column
from ..functions.ranks import MID, PID, ntile_of, partition_row_numbers, running_sums, sorted_frozen
from ..session import checkpointed


def _cutoff_array(cutoffs: Sequence[str], dtype: str) -> Column:
    return F.array(*[F.lit(c).cast(dtype) for c in sorted(cutoffs)])


def _bucket(date_col: str, cutoffs: Sequence[str], dtype: str) -> Column:
    """0-based index of the first cut-off >= date (len(cutoffs) when none)."""
    arr = _cutoff_array(cutoffs, dtype)
    return F.size(F.filter(arr, lambda c: c < F.col(date_col)))


def _cutoff_frame(df: DataFrame, cutoffs: Sequence[str], dtype: str) -> DataFrame:
    spark = df.sparkSession
    rows = [(i, c) for i, c in enumerate(sorted(cutoffs))]
    return spark.createDataFrame(rows, "bucket int, cutoff string").select(
        "bucket", F.col("cutoff").cast(dtype).alias("cutoff")
    )


def totals_at_cutoffs(
    df: DataFrame, date_column: str, cutoffs: Sequence[str], aggs: dict[str, Column]
) -> DataFrame:
    """For each cut-off c: additive aggregates (counts, sums) over the rows
    with date <= c. Rows are bucketed by the first cut-off at or after their
    date, aggregated per bucket (map-side combined), and the buckets' totals
    are accumulated over the handful of cut-offs."""
    f = require_column(df, date_column)
    dtype = f.dataType.simpleString()
    per = (
        df.where(F.col(date_column).isNotNull())
        .withColumn("bucket", _bucket(date_column, cutoffs, dtype))
        .where(F.col("bucket") < len(cutoffs))
        .groupBy("bucket")
        .agg(*[a.alias(n) for n, a in aggs.items()])
    )
    cuts = _cutoff_frame(df, cutoffs, dtype)
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # one row per cut-off
    filled = F.broadcast(cuts).join(per, "bucket", "left")
    return filled.select(
        "cutoff", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in aggs]
    )


def latest_as_of(
    df: DataFrame,
    key: str,
    date_column: str,
    cutoffs: Sequence[str],
    columns: Sequence[str],
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """For each cut-off and key: the latest row with date <= cut-off (ties on
    the date go to the largest ``tiebreak`` values). Output: cutoff, key,
    date and ``columns``.

    ``max_by`` per (key, interval) is a map-side-combined aggregation, so a
    key with a third of all rows never lands whole in one task; the carry
    forward to later cut-offs is a window over each key's <= len(cutoffs)
    interval winners.
    """
    f = require_column(df, date_column)
    dtype = f.dataType.simpleString()
    order = F.struct(F.col(date_column), *[F.col(t) for t in tiebreak])
    payload = F.struct(F.col(date_column).alias("_d"), *[F.col(c) for c in columns])
    per = (
        df.where(F.col(date_column).isNotNull())
        .withColumn("bucket", _bucket(date_column, cutoffs, dtype))
        .where(F.col("bucket") < len(cutoffs))
        .groupBy(key, "bucket")
        .agg(F.max_by(payload, order).alias("_row"))
    )
    # each interval winner is the answer for its own cut-off and for every later
    # one until a later interval of the same key has a winner
    nxt = F.lead("bucket", 1).over(Window.partitionBy(key).orderBy("bucket"))
    spans = per.withColumn("_until", F.coalesce(nxt, F.lit(len(cutoffs))))
    cuts = _cutoff_frame(df, cutoffs, dtype)
    out = spans.join(
        F.broadcast(cuts.withColumnRenamed("bucket", "_b")),
        (F.col("_b") >= F.col("bucket")) & (F.col("_b") < F.col("_until")),
    )
    return out.select(
        "cutoff", key, F.col("_row._d").alias(date_column), *[F.col(f"_row.{c}").alias(c) for c in columns]
    )


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    columns: Sequence[str],
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Every row of ``left`` with ``columns`` of the latest row of ``right`` that has the
    same ``keys`` and is not later than ``left_time`` (ties on the time go to the
    largest ``tiebreak`` values); nulls if there is none. A null key or time matches
    nothing. Key columns have the same names in both tables.

    Both tables are sorted together by one range shuffle on (keys, time), so a key
    with a third of all rows is spread over many tasks. Within a sorted partition the
    last right row is carried forward; where a key goes on from earlier partitions,
    their last right row is: one row a partition, sent to all.
    """
    keys = list(keys)
    by = [f"_k{i}" for i in range(len(keys))]
    ids = [F.col(k).alias(b) for k, b in zip(keys, by)]
    blank = F.lit(None)
    named = F.struct(*[F.col(c) for c in columns])
    ties = F.struct(*[F.col(c) for c in tiebreak]) if tiebreak else F.struct(F.lit(0).alias("_0"))
    rows = F.struct(*[F.col(c) for c in left.columns])
    found = right.select(*ids, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), ties.alias("_tie"), named.alias("_found"), blank.alias("_row"))
    found = found.where(" AND ".join(f"{c} IS NOT NULL" for c in [*by, "_t"]))
    asked = left.select(*ids, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), blank.alias("_tie"), blank.alias("_found"), rows.alias("_row"))
    order = [F.col(c).asc_nulls_first() for c in [*by, "_t", "_side", "_tie"]]
    both = sorted_frozen(found.unionByName(asked), order)
    run = Window.partitionBy(PID, *by).orderBy(MID).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = both.select(PID, *by, "_t", "_side", "_row", F.last("_found", ignorenulls=True).over(run).alias("_here"))
    last = F.when(F.col("_side") == 0, F.struct(*by, "_found"))
    ends = both.groupBy(PID).agg(F.max_by(last, F.when(F.col("_side") == 0, F.col(MID))).alias("_last"))
    before = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    ends = ends.select(F.col(PID).alias("_p"), F.last("_last", ignorenulls=True).over(before).alias("_from"))
    out = here.where("_side = 1").join(F.broadcast(ends), F.col(PID) == F.col("_p"))
    same = " AND ".join(f"_from.{b} = {b}" for b in by)
    value = F.when(F.col("_t").isNotNull(), F.coalesce("_here", F.when(F.expr(same), F.col("_from._found"))))
    out = out.select("_row", value.alias("_value"))
    return out.select("_row.*", *[F.col("_value").getField(c).alias(c) for c in columns])


def totals_as_of(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, sums: dict[str, Column]
) -> DataFrame:
    """Every row of ``left`` with running totals over the rows of ``right`` that have the
    same ``keys`` and are not later than ``left_time`` (a range join with a table of
    cut-offs). ``sums``: name -> a number of each right row, null as 0 (``F.lit(1)``
    counts). A null key or time gives 0.

    Both tables are sorted together once; a running sum over all of it, less its value
    at the key's first row, is the total. No pair of rows is ever formed.
    """
    keys = list(keys)
    by = [f"_k{i}" for i in range(len(keys))]
    ids = [F.col(k).alias(b) for k, b in zip(keys, by)]
    names = [f"_s{i}" for i in range(len(sums))]
    rows = F.struct(*[F.col(c) for c in left.columns])
    values = [F.coalesce(c, F.lit(0)).alias(n) for n, c in zip(names, sums.values())]
    added = right.select(*ids, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), *values)
    added = added.where(" AND ".join(f"{c} IS NOT NULL" for c in [*by, "_t"]))
    zeros = [F.lit(0).cast(added.schema[n].dataType).alias(n) for n in names]
    asked = left.select(*ids, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), rows.alias("_row"), *zeros)
    order = [F.col(c).asc_nulls_first() for c in [*by, "_t", "_side"]]
    # one row before all others of a key, at which its running sum stands at the start
    opening = asked.select(*by).distinct().select(*by, F.lit(-1).alias("_side"), *zeros)
    both = added.unionByName(asked).unionByName(opening, allowMissingColumns=True)
    summed = checkpointed(running_sums(both, order, names))
    base = summed.where("_side = -1").select(*[F.col(b).alias(f"_of{b}") for b in by], *[F.col(f"cum_{n}").alias(f"_b{n}") for n in names])
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_of{b}")) for b in by])
    out = summed.where("_side = 1").join(base, same)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, "_t"]])
    totals = [F.when(known, F.col(f"cum_{n}") - F.col(f"_b{n}")).otherwise(0).alias(name) for n, name in zip(names, sums)]
    return out.select("_row", *totals).select("_row.*", *sums)


def flag_membership(
    df: DataFrame, key: str, other: DataFrame, other_key: str, name: str, when_in, when_out
) -> DataFrame:
    """``CASE WHEN key IN (SELECT other_key ...) THEN a ELSE b END`` as a left
    join against the distinct keys of ``other``, which are written before it."""
    keys = other.select(F.col(other_key).alias("_mk")).where(F.col("_mk").isNotNull()).distinct()
    keys = checkpointed(keys)
    return (
        df.join(keys, F.col(key) == F.col("_mk"), "left")
        .withColumn(name, F.when(F.col("_mk").isNotNull(), F.lit(when_in)).otherwise(F.lit(when_out)))
        .drop("_mk")
    )


HALO_BLOCK = 65_536


def ordered_window(
    df: DataFrame,
    partition: Sequence[str],
    order: Sequence[Column],
    value: str,
    lags: Sequence[int] = (1,),
    ntile: int | None = None,
    name: str = "rn",
    frames: dict[str, tuple[Callable[[Column], Column], int]] | None = None,
) -> DataFrame:
    """ROW_NUMBER, LAG(value, k), NTILE and framed aggregates inside a
    partition, skew-proof. ``frames``: column name -> (aggregate such as
    ``F.avg``, n) over ROWS BETWEEN n PRECEDING AND CURRENT ROW. Adds ``rn``,
    ``{name}_count``, ``lag{k}``, ``ntile`` and the frames' columns.

    One range-partitioned sort numbers the rows, and lags and frames are windows
    over blocks of consecutive numbers, each with a halo of the rows before it that
    its first rows look back to: no task ever sorts a whole partition.
    """
    frames = frames or {}
    keys = list(partition)
    back = max([0, *lags, *[n for _, n in frames.values()]])
    block = max(HALO_BLOCK, 2 * back)
    indexed = partition_row_numbers(df, keys, order, name).drop("_grn")
    at = F.floor((F.col(name) - 1) / block).cast("long")
    # the last rows of a block are also needed by the next one
    near_end = (F.col(name) - 1) % block >= block - back if back else F.lit(False)
    places = F.when(near_end, F.array(at, at + 1)).otherwise(F.array(at))
    placed = indexed.withColumn("_block", F.explode(places)).withColumn("_own", F.col("_block") == at)
    run = Window.partitionBy(*keys, "_block").orderBy(name)
    out = placed
    for k in lags:
        out = out.withColumn(f"lag{k}", F.lag(value, k).over(run))
    for column, (aggregate, n) in frames.items():
        out = out.withColumn(column, aggregate(F.col(value)).over(run.rowsBetween(-n, 0)))
    if ntile:
        out = out.withColumn("ntile", ntile_of(F.col(name), F.col(f"{name}_count"), ntile))
    return out.where("_own").drop("_block", "_own")
