"""Entity analytics: cohort retention (T16), funnel (T17), RFM scoring."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.columns import (
    OperatorError,
    require_column,
    require_grain,
    require_numeric,
    require_temporal,
    timestampdiff,
    truncate,
)
from ..functions.numeric import dround
from ..functions.selection import Held, bounds, value_at
from ..session import checkpointed


class Result(NamedTuple):
    table: DataFrame
    metrics: DataFrame


def cohort_retention(df: DataFrame, entity: str, date_column: str, granularity: str = "month") -> Result:
    """Cohort = first active period of an entity; per (cohort, offset) the
    number of its entities active that period and the share of the cohort
    (1 dp). Headline: mean offset-1 retention over the cohorts that have an
    offset-1 row.

    Rows with a null date are dropped for both cohort and activity, rows with
    a null entity vanish (they cannot be matched to a cohort). The distinct
    (entity, period) pairs are aggregated map-side first, so an entity with a
    third of all events still contributes one row per period to the shuffle;
    the cohort is a window over each entity's few periods (no self-join).
    """
    require_column(df, entity)
    dt = require_temporal(df, date_column).dataType
    require_grain(granularity)
    act = (
        df.where(F.col(date_column).isNotNull() & F.col(entity).isNotNull())
        .select(F.col(entity).alias("ent"), truncate(date_column, granularity, dt).alias("period"))
        .distinct()
    )
    with_cohort = act.withColumn("cohort", F.min("period").over(Window.partitionBy("ent")))
    counts = with_cohort.groupBy(
        "cohort", timestampdiff(granularity, "cohort", "period").cast("long").alias("period_offset")
    ).agg(F.count(F.lit(1)).alias("active"))
    # cohorts are bounded by the calendar (one per period), so this window is small
    size = F.max(F.when(F.col("period_offset") == 0, F.col("active"))).over(Window.partitionBy("cohort"))
    table = (
        counts.withColumn("_size", size)
        .select(
            "cohort",
            "period_offset",
            "active",
            F.when(F.col("_size").isNull() | (F.col("_size") == 0), F.lit(None).cast("double"))
            .otherwise(dround(F.col("active") * F.lit(100.0) / F.col("_size"), 1))
            .alias("retention_pct"),
        )
        .orderBy("cohort", "period_offset")
    )
    metrics = table.agg(
        F.count(F.when(F.col("period_offset") == 0, F.lit(1))).alias("cohorts"),
        dround(F.avg(F.when(F.col("period_offset") == 1, F.col("retention_pct"))), 1).alias(
            "avg_next_period_retention_pct"
        ),
        F.count(F.lit(1)).alias("_rows"),
    ).select(
        F.when(F.col("_rows") == 0, F.raise_error(F.lit("there are no rows with a date to build cohorts from")))
        .otherwise(F.col("cohorts"))
        .alias("cohorts"),
        "avg_next_period_retention_pct",
    )
    return Result(table, metrics)


def funnel(df: DataFrame, entity: str, stage_column: str, steps: Sequence[str]) -> Result:
    """Distinct entities per listed stage (stage compared as text; counts are
    independent per stage, with no ordering in time), pct_of_prev and
    pct_of_start (1 dp; null when the divisor is 0). One aggregation over the
    rows whose stage is listed; the step list is a broadcast literal table."""
    require_column(df, entity)
    require_column(df, stage_column)
    steps = [str(s) for s in steps]
    if len(steps) < 2:
        raise OperatorError("a funnel takes two steps or more, in order")
    spark = df.sparkSession
    stage = F.col(stage_column).cast("string")
    counts = (
        df.where(stage.isin(*steps) & F.col(entity).isNotNull())
        .groupBy(stage.alias("step"))
        .agg(F.countDistinct(entity).alias("entities"))
    )
    step_df = spark.createDataFrame(list(enumerate(steps)), "step_idx int, step string")
    w = Window.orderBy("step_idx")  # over the handful of listed steps only
    joined = F.broadcast(step_df).join(counts, "step", "left").select(
        "step_idx", "step", F.coalesce(F.col("entities"), F.lit(0)).cast("long").alias("entities")
    )
    prev = F.lag("entities", 1).over(w)
    start = F.first("entities").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    table = joined.select(
        "step_idx",
        "step",
        "entities",
        F.when(prev.isNull() | (prev == 0), F.lit(None).cast("double"))
        .otherwise(dround(F.col("entities") * F.lit(100.0) / prev, 1))
        .alias("pct_of_prev"),
        F.when(start == 0, F.lit(None).cast("double"))
        .otherwise(dround(F.col("entities") * F.lit(100.0) / start, 1))
        .alias("pct_of_start"),
    ).orderBy("step_idx")
    last = len(steps) - 1
    metrics = table.agg(
        F.max(F.when(F.col("step_idx") == 0, F.col("entities"))).alias("start_entities"),
        F.max(F.when(F.col("step_idx") == last, F.col("entities"))).alias("end_entities"),
        F.max(F.when(F.col("step_idx") == last, F.col("pct_of_start"))).alias("overall_conversion_pct"),
    )
    return Result(table, metrics)


def _fifths(per: DataFrame, measures: dict[str, Column]) -> dict[str, list[tuple]]:
    """The first (value, entity) of the second to fifth NTILE(5) bucket of each measure,
    ascending with nulls last, ties by entity."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), c.cast("double").alias("v")) for m, c in measures.items()]))
    rows = per.select("entity", each.alias("_x")).select("entity", "_x.m", "_x.v")
    ends = Held(rows.groupBy("m").agg(F.count(F.lit(1)).alias("n"), *bounds(F.col("v"), DoubleType()))).df
    n = (ends.first() or {"n": 0})["n"]
    size, more = divmod(n, 5)
    starts = [t * size + min(t, more) for t in range(1, 5)]
    places = [F.struct(F.lit(t).alias("pid"), F.lit(pos).cast("long").alias("pos")) for t, pos in enumerate(starts) if pos < n]
    if not places:
        return {m: [] for m in measures}
    wanted = ends.select("m", F.explode(F.array(*places)).alias("_t")).select("m", "_t.*")
    values = value_at(rows, ["m"], "v", wanted, ends, ties=True)
    first = value_at(rows, ["m", "v"], "entity", values.withColumnRenamed("rel", "pos"))
    out: dict[str, list[tuple]] = {m: [] for m in measures}
    for r in first.select("m", "v", "entity").collect():  # twelve rows at most
        out[r.m].append((r.v, r.entity))
    return out


def _not_before(value: Column, cut: tuple, dtype: str) -> Column:
    """(value, entity) is not before ``cut``, ascending with nulls last."""

    def key(v: Column, e: Column) -> Column:
        parts = {"a": v.isNull(), "b": v.cast("double"), "c": e.isNull(), "d": e}
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    return key(value, F.col("entity")) >= key(F.lit(cut[0]), F.lit(cut[1]).cast(dtype))


class Rfm(NamedTuple):
    scored: DataFrame  # entity, recency_days, frequency, monetary, r/f/m scores
    segments: DataFrame  # rfm_score, entities
    metrics: DataFrame  # entities, champions, champions_pct


def rfm(df: DataFrame, entity: str, date_column: str, monetary: str, top_segments: int | None = None) -> Rfm:
    """Recency (days from an entity's last date to the table's last date),
    frequency (rows) and monetary (ROUND(SUM, 2)) per entity, each scored by
    NTILE(5): recency descending (5 = most recent), frequency and monetary
    ascending with nulls last. Ties are broken by the entity (nulls last) so
    scores are deterministic. A null entity is a group of its own. All segments
    (125 at most) are returned unless ``top_segments`` asks for the largest.

    Scores need no sort of all entities: the first entity of each of the four upper
    fifths is selected by counting (``selection.value_at``), by value and then, among
    the entities with that value, by entity, for the three measures at once; twelve
    such rows at most are compared with every entity.
    """
    require_column(df, entity)
    require_temporal(df, date_column)
    require_numeric(df, monetary)
    base = df.where(F.col(date_column).isNotNull())
    day = F.col(date_column).cast("date")
    last_day = base.agg(F.max(day).alias("_last"))
    per = (
        base.groupBy(F.col(entity).alias("entity"))
        .agg(
            F.max(day).alias("_mx"),
            F.count(F.lit(1)).alias("frequency"),
            dround(F.sum(F.col(monetary).cast("double")), 2).alias("monetary"),
        )
        .crossJoin(F.broadcast(last_day))
        .select("entity", F.datediff("_last", "_mx").alias("recency_days"), "frequency", "monetary")
    )
    per = checkpointed(per)
    # most recent last, so the smallest days come last
    measures = {"r": -F.col("recency_days"), "f": F.col("frequency"), "m": F.col("monetary")}
    cuts, dtype = _fifths(per, measures), per.schema["entity"].dataType.simpleString()
    scores = [
        (1 + sum((F.when(_not_before(measures[k], cut, dtype), 1).otherwise(0) for cut in cuts[k]), F.lit(0))).cast("long").alias(f"{k}_score")
        for k in measures
    ]
    scored = per.select("entity", "recency_days", "frequency", "monetary", *scores)
    segments = (
        scored.groupBy(
            F.concat_ws("-", F.col("r_score").cast("string"), F.col("f_score").cast("string"), F.col("m_score").cast("string")).alias(
                "rfm_score"
            )
        )
        .agg(F.count(F.lit(1)).alias("entities"))
        .orderBy(F.col("entities").desc(), F.col("rfm_score").asc())
    )
    if top_segments is not None:
        segments = segments.limit(top_segments)
    champ = (F.col("r_score") >= 4) & (F.col("f_score") >= 4) & (F.col("m_score") >= 4)
    metrics = scored.agg(
        F.count(F.lit(1)).alias("entities"),
        F.count(F.when(champ, F.lit(1))).alias("champions"),
    ).select(
        F.when(F.col("entities") == 0, F.raise_error(F.lit("there are no rows with a date to score")))
        .otherwise(F.col("entities"))
        .alias("entities"),
        "champions",
        F.when(F.col("entities") == 0, F.lit(None).cast("double"))
        .otherwise(dround(F.col("champions") * F.lit(100.0) / F.col("entities"), 1))
        .alias("champions_pct"),
    )
    return Rfm(scored, segments, metrics)
