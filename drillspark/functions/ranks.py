"""Global order statistics without a single-partition window.

``Window.orderBy(...)`` with no partition moves every row into one task. The
helpers here sort with a range shuffle instead, freeze the sorted partitions
with a reliable checkpoint (so partition ids stay valid if an executor is lost
and work is redone), and add to each row the total of all earlier partitions.
That offset table has one row per partition - its size is bounded by the
partition count, never by the data - so it is broadcast.

Built on it: running sums over distinct values (ranks with ties, Mann-Whitney U)
and global row numbers. Quantiles need no order of all rows: see ``selection``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import checkpointed, join_back
from .selection import Held, bounds, value_at

PID, MID = "_rk_pid", "_rk_mid"


def sorted_frozen(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` sorted by one range shuffle and written, with each row's partition
    and place."""
    placed = df.orderBy(*order).withColumn(PID, F.spark_partition_id()).withColumn(MID, F.monotonically_increasing_id())
    return checkpointed(placed)


def _offsets(frozen: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Per partition id: exclusive running totals of the given sums (tiny)."""
    per = frozen.groupBy(PID).agg(*[s.alias(f"_p_{n}") for n, s in sums.items()])
    w = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(
        PID, *[F.coalesce(F.sum(f"_p_{n}").over(w), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )


def row_numbers(df: DataFrame, order: Sequence[Column], name: str = "row_number") -> DataFrame:
    """Add a 1-based global row number in ``order``.

    The order must be total (add a key as last tie-breaker) for a
    deterministic answer. No window: the row's index inside its sorted
    partition comes from ``monotonically_increasing_id`` (partition id in the
    upper bits), plus the count of rows in earlier partitions.
    """
    frozen = sorted_frozen(df, order)
    offs = _offsets(frozen, {"n": F.count(F.lit(1))})
    local = F.col(MID) - F.shiftleft(F.col(PID).cast("long"), 33)
    return (
        frozen.join(F.broadcast(offs), PID)
        .withColumn(name, (F.col("_o_n") + local + F.lit(1)).cast("long"))
        .drop(PID, MID, "_o_n")
    )


def running_sums(
    df: DataFrame, order: str | Sequence[str | Column], cols: Sequence[str], prefix: str = "cum_"
) -> DataFrame:
    """Inclusive running sums of ``cols`` in ``order`` (a column name or a
    list of names/sort expressions; must be a total order)."""
    order_list = [order] if isinstance(order, str) else list(order)
    sort = [F.col(o).asc() if isinstance(o, str) else o for o in order_list]
    frozen = sorted_frozen(df, sort)
    offs = _offsets(frozen, {c: F.sum(c) for c in cols})
    # a sorted partition stays whole, and is no larger than the range shuffle made it
    so_far = Window.partitionBy(PID).orderBy(MID).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = frozen.join(F.broadcast(offs), PID)
    for c in cols:
        out = out.withColumn(f"{prefix}{c}", F.coalesce(F.sum(c).over(so_far), F.lit(0)) + F.col(f"_o_{c}"))
    return out.drop(PID, MID, *[f"_o_{c}" for c in cols])


def value_counts(df: DataFrame, value: str, weights: dict[str, Column] | None = None) -> DataFrame:
    """Distinct non-null values with counts (and optional extra sums), plus
    inclusive running totals ``cum_*`` in value order.

    Grouping first means a value that holds a third of all rows is one row
    here: the sort that follows never sees the skew.
    """
    weights = weights or {}
    agg = (
        df.where(F.col(value).isNotNull())
        .groupBy(value)
        .agg(F.count(F.lit(1)).alias("cnt"), *[w.alias(n) for n, w in weights.items()])
    )
    return running_sums(agg, value, ["cnt", *weights])


def average_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """value -> average rank (1-based; ties share the mean of their positions)."""
    vc = value_counts(df, value)
    return vc.select(
        value, ((F.col("cum_cnt") - F.col("cnt")) + (F.col("cnt") + F.lit(1)) / F.lit(2.0)).alias(name)
    )


def _keyed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """Rename key columns to ``{prefix}{i}`` so a join with a frame derived
    from the same source has no ambiguous attributes."""
    ren = {k: f"{prefix}{i}" for i, k in enumerate(keys)}
    return df.select(*[F.col(c).alias(ren[c]) if c in ren else F.col(c) for c in df.columns])


def _keys_match(keys: Sequence[str], left_prefix: str | None, right_prefix: str) -> Column:
    """Null-safe equality of the renamed key columns (null matches null)."""
    cond = None
    for i, k in enumerate(keys):
        lcol = F.col(k) if left_prefix is None else F.col(f"{left_prefix}{i}")
        c = lcol.eqNullSafe(F.col(f"{right_prefix}{i}"))
        cond = c if cond is None else cond & c
    return cond


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], prefix: str = "q", by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated quantiles (SQL ``quantile_cont``) of a numeric
    column, overall or per group of ``by``: one row per group with ``n`` and
    ``{prefix}0, {prefix}1, ...`` (null when the group has no values).

    Position h = (n - 1) * p; the answer is x[floor h] + (x[ceil h] - x[floor h])
    * (h - floor h). The values at these positions are selected by counting
    (``selection.value_at``): nothing is sorted and no row is moved.
    """
    by = list(by)
    vals = df.select(*[F.col(b) for b in by], F.col(value).cast("double").alias("_value"))
    # every group gets a row, also one whose values are all null (n = 0)
    groups = vals.groupBy(*by).agg(F.count("_value").alias("n"), *bounds(F.col("_value"), DoubleType()))
    groups = Held(groups).df
    place = lambda p: (F.col("n") - F.lit(1)).cast("double") * F.lit(float(p))
    wanted = [
        F.struct(F.lit(2 * i + k).alias("pid"), side(place(p)).cast("long").alias("pos"))
        for i, p in enumerate(probs)
        for k, side in enumerate((F.floor, F.ceil))
    ]
    targets = groups.where("n > 0").select(*by, F.explode(F.array(*wanted)).alias("_t")).select(*by, "_t.*")
    got = value_at(vals.where(F.col("_value").isNotNull()), by, "_value", targets, groups.where("n > 0"))
    at = [F.max(F.when(F.col("pid") == k, F.col("_value"))).alias(f"_x{k}") for k in range(2 * len(probs))]
    wide = _keyed(got.groupBy(*by).agg(*at), by, "_s")
    out = groups.join(wide, _keys_match(by, None, "_s"), "left") if by else groups.crossJoin(F.broadcast(wide))  # one row each
    made = []
    for i, p in enumerate(probs):
        low, high, h = F.col(f"_x{2 * i}"), F.col(f"_x{2 * i + 1}"), place(p)
        made.append(F.when(h == F.floor(h), low).otherwise(low + (high - low) * (h - F.floor(h))).alias(f"{prefix}{i}"))
    return out.select(*by, "n", *made)


def partition_row_numbers(
    df: DataFrame, partition: Sequence[str], order: Sequence[Column], name: str = "rn"
) -> DataFrame:
    """ROW_NUMBER() OVER (PARTITION BY partition ORDER BY order), skew-proof.

    A partitioned window sends each key to one task, so a key with a third of
    all rows is sorted by one task. Here one global range-partitioned sort on
    (partition, order) spreads such a key over many tasks; the row number
    inside the key is the global row number minus that of the key's first row.
    Also adds ``{name}_count`` (rows in the key) and ``_grn`` (global row
    number, unique: a lag inside the key is a join on ``_grn - k``).
    The order must be total within a key for a deterministic answer.
    """
    keys = list(partition)
    numbered = row_numbers(df, [F.col(k).asc_nulls_first() for k in keys] + list(order), "_grn")
    starts = _keyed(
        numbered.groupBy(*keys).agg(F.min("_grn").alias("_g0"), F.count(F.lit(1)).alias(f"{name}_count")),
        keys,
        "_s",
    )
    return (
        join_back(numbered, starts, _keys_match(keys, None, "_s"))
        .withColumn(name, F.col("_grn") - F.col("_g0") + F.lit(1))
        .drop("_g0", *[f"_s{i}" for i in range(len(keys))])
    )


def ntile_of(row_number: Column, n: Column, k: int) -> Column:
    """SQL NTILE(k) from a 1-based row number among n rows: the first n mod k
    buckets hold one row more than the rest."""
    i = row_number - F.lit(1)
    q = F.floor(n / F.lit(k)).cast("long")
    r = n - q * F.lit(k)
    big = r * (q + F.lit(1))
    return (
        F.when(i < big, F.floor(i / (q + F.lit(1))))
        .otherwise(r + F.floor((i - big) / F.when(q == 0, F.lit(1)).otherwise(q)))
        .cast("long")
        + F.lit(1)
    )
