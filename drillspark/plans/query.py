"""Running analysis SQL (Q1-Q4): capped queries with an exact truncation
flag, steps that reuse each other's results, deterministic re-runs compared
row for row, and named metrics with one definition everywhere.

SQL text is handed to Spark's own parser and planner; nothing here parses
SQL. Statements that are not queries (DDL, INSERT, several statements) fail
inside the wrapping ``SELECT * FROM (...)``.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed


def _has_own_limit(spark: SparkSession, sql: str) -> bool:
    """Does the query itself end in a LIMIT? Asked of Spark's parsed plan, so comments,
    strings and LIMITs of subqueries do not count. A LIMIT over a set operation does
    not either: such queries are capped like any other."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    while plan.nodeName() in ("UnresolvedWith", "WithCTE"):
        plan = plan.child() if plan.nodeName() == "UnresolvedWith" else plan.plan()
    if plan.nodeName() != "GlobalLimit":
        return False
    while plan.nodeName() in ("GlobalLimit", "LocalLimit", "Offset", "Sort"):
        plan = plan.child()
    return plan.nodeName() not in ("Union", "Distinct", "Intersect", "Except")


class Capped(NamedTuple):
    rows: DataFrame  # all rows, or ``cap`` of them at most
    meta: DataFrame  # row_count, truncated


def run_query(spark: SparkSession, sql: str, cap: int | None = None) -> Capped:
    """Run one query, with a row cap if the caller asks for one and the query
    has no LIMIT of its own at its end. A capped query is wrapped and limited
    to cap + 1 rows, so ``truncated`` is exact: true only when more than
    ``cap`` rows exist. An ORDER BY inside the query survives the wrap, and
    several statements in one text do not."""
    body = sql.strip().rstrip(";").rstrip()
    if cap is None or _has_own_limit(spark, body):
        df = spark.sql(f"SELECT * FROM (\n{body}\n) q")
        return Capped(df, df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("truncated", F.lit(False)))
    probe = spark.sql(f"SELECT * FROM (\n{body}\n) q LIMIT {int(cap) + 1}")
    meta = probe.agg(F.count(F.lit(1)).alias("_n")).select(
        F.least(F.col("_n"), F.lit(int(cap))).cast("long").alias("row_count"),
        (F.col("_n") > int(cap)).alias("truncated"),
    )
    return Capped(probe.limit(int(cap)), meta)


def _refs(sql: str, step_id: str) -> int:
    return len(re.findall(rf"\bstep_{re.escape(step_id)}\b", sql))


def run_steps(
    spark: SparkSession, steps: Sequence[tuple[str, str]] | Mapping[str, str], store_shared: bool = True
) -> "OrderedDict[str, DataFrame]":
    """Run analysis steps in order; each result is registered as the view
    ``step_<id>`` so a later step can build on it instead of recomputing.
    Plans stay lazy (a reference is inlined like a CTE); a result that later
    steps use at least twice is written to the checkpoint folder, so it is
    computed once."""
    items = list(steps.items()) if isinstance(steps, Mapping) else list(steps)
    out: OrderedDict[str, DataFrame] = OrderedDict()
    for i, (sid, sql) in enumerate(items):
        if not re.fullmatch(r"[A-Za-z0-9_]+", sid):
            raise ValueError(f"step id must be alphanumeric: {sid!r}")
        df = spark.sql(sql)
        later = sum(_refs(s, sid) for _, s in items[i + 1 :])
        if store_shared and later >= 2:
            df = checkpointed(df)
        df.createOrReplaceTempView(f"step_{sid}")
        out[sid] = df
    return out


def _same_columns(first: DataFrame, second: DataFrame) -> None:
    if [(f.name, f.dataType) for f in first.schema] != [(f.name, f.dataType) for f in second.schema]:
        raise ValueError("results with different columns cannot be compared")


def diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """Row-for-row comparison as multisets: rows only in the first, only in
    the second, and whether the results are identical. One row, from one
    aggregation over both: a row's copies count +1 in the first and -1 in the
    second."""
    _same_columns(first, second)
    names = [f"c{i}" for i in range(len(first.columns))]
    both = first.toDF(*names).withColumn("__w", F.lit(1)).unionAll(second.toDF(*names).withColumn("__w", F.lit(-1)))
    rows = both.groupBy(*names).agg(F.sum("__w").alias("__w"))
    counted = rows.agg(
        F.coalesce(F.sum(F.greatest("__w", F.lit(0))), F.lit(0)).alias("only_in_first"),
        F.coalesce(F.sum(F.greatest(-F.col("__w"), F.lit(0))), F.lit(0)).alias("only_in_second"),
    )
    return counted.withColumn("identical", (F.col("only_in_first") == 0) & (F.col("only_in_second") == 0))


class Fingerprint(NamedTuple):
    """A result as a multiset: how many rows, and two sums of independent 64-bit hashes
    of them. Sums do not depend on the order or the placing of rows, so equal
    multisets have equal fingerprints, and different ones all but surely not."""

    rows: int
    first: int
    second: int


def _hashable(f: T.StructField) -> Column:
    """A column whose hash is equal where values count as equal: maps (which have no
    hash) as sorted entries, both zeros as one."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(c)))
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return F.when(c == 0, F.lit(0.0)).otherwise(c)
    return c


def fingerprint(df: DataFrame) -> Fingerprint:
    """The fingerprint of a result, in one pass that moves no rows."""
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    cols = [_hashable(f) for f in named.schema.fields]
    # nulls are skipped by the hash: which ones there are is hashed, too
    cols.append(F.concat_ws("", *[F.col(c).isNull().cast("string") for c in named.columns]))
    total = [F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(20,0)")) for seed in (0x51, 0xA7)]
    n, a, b = named.agg(F.count(F.lit(1)), *total).first()
    return Fingerprint(int(n), int(a or 0), int(b or 0))


class Stored(NamedTuple):
    """A written result and its fingerprint."""

    rows: DataFrame
    mark: Fingerprint


def store(df: DataFrame) -> Stored:
    """The result as a written table, for a later ``rerun``."""
    rows = checkpointed(df)
    return Stored(rows, fingerprint(rows))


def compare(first: Stored | DataFrame, again: DataFrame) -> DataFrame:
    """``diff`` of a first result and another one. A stored first result is compared by
    fingerprint; rows are only shuffled and matched if that differs. With its
    fingerprint alone at hand (``rows`` deleted) only equality could be told."""
    if not isinstance(first, Stored):
        return diff(first, again)
    _same_columns(first.rows, again)
    if fingerprint(again) == first.mark:
        return again.sparkSession.range(1).select(
            F.lit(0).cast("long").alias("only_in_first"), F.lit(0).cast("long").alias("only_in_second"), F.lit(True).alias("identical")
        )
    return diff(first.rows, again)


def rerun(spark: SparkSession, sql: str, first: Stored | DataFrame | None = None) -> DataFrame:
    """Re-execute a query and compare it with its first result: a stored one,
    or (none given) one that is written now, so that the comparison reads two
    executions and not one twice."""
    return compare(store(spark.sql(sql)) if first is None else first, spark.sql(sql))


def store_steps(results: Mapping[str, DataFrame]) -> "OrderedDict[str, Stored]":
    """The steps' results as written tables, for a later ``rerun_steps``."""
    return OrderedDict((sid, store(df)) for sid, df in results.items())


def rerun_steps(spark: SparkSession, steps: Sequence[tuple[str, str]], first: Mapping[str, Stored | DataFrame]) -> DataFrame:
    """Re-run a whole step list against its stored results; one comparison
    row per step."""
    again = run_steps(spark, steps, store_shared=False)
    rows = None
    for sid, df in again.items():
        d = compare(first[sid], df).select(F.lit(sid).alias("step"), "*")
        rows = d if rows is None else rows.unionByName(d)
    return rows


class Metric(NamedTuple):
    name: str
    sql: str
    description: str = ""


class Metrics:
    """Named metrics: ``name = SQL aggregate expression | description``,
    defined once and reused verbatim by every later query."""

    def __init__(self) -> None:
        self._defs: OrderedDict[str, Metric] = OrderedDict()

    def define(self, name: str, sql: str, description: str = "") -> Metric:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
            raise ValueError(f"metric name must be an identifier: {name!r}")
        m = Metric(name, sql.strip(), description)
        self._defs[name] = m
        return m

    def parse(self, line: str) -> Metric:
        """``name = expression | description``"""
        if "=" not in line:
            raise ValueError("expected 'name = SQL expression | description'")
        name, rest = line.split("=", 1)
        expr, _, desc = rest.partition("|")
        return self.define(name.strip(), expr.strip(), desc.strip())

    def __getitem__(self, name: str) -> Metric:
        return self._defs[name]

    def names(self) -> list[str]:
        return list(self._defs)

    def as_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(m.name, m.sql, m.description) for m in self._defs.values()], "name string, sql string, description string"
        )


def metric_by(df: DataFrame, metrics: Metrics, names: Iterable[str], dims: Sequence[str] = ()) -> DataFrame:
    """Evaluate named metrics grouped by ``dims`` (or overall) in one
    aggregation, each column named after its metric."""
    exprs = [F.expr(metrics[n].sql).alias(n) for n in names]
    return df.groupBy(*dims).agg(*exprs) if dims else df.agg(*exprs)
