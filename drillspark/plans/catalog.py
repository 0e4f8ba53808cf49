"""Registered queries over the driver tables, each with its DuckDB SQL twin.

Every entry reads whole tables from ``sf_dir`` (no id subsets, no row caps)
and returns a lazy DataFrame whose column names equal the SQL's aliases.
Operators that cannot be written in plain SQL register ``sql=None``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise KeyError(f"query {name!r} registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def queries() -> dict[str, QueryFn]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}


def _load_all() -> None:
    # importing the modules registers their queries
    from . import (  # noqa: F401
        q_change,
        q_customers,
        q_onecol,
        q_series,
        q_tests,
        q_relational,
        q_sources,
        q_graph,
    )


def flat_arrays(df: DataFrame, sep: str = "; ") -> DataFrame:
    """array<string> columns as joined text (SQL twin: array_to_string)."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import ArrayType

    return df.select(
        *[
            F.array_join(F.col(f.name), sep).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def round6(df: DataFrame, cols) -> DataFrame:
    """Unrounded float statistics at 6 dp, so two engines summing in different
    orders report the same digits (SQL twin: ROUND(x, 6))."""
    from ..functions.numeric import dround

    return df.select(*[dround(c, 6).alias(c) if c in cols else c for c in df.columns])
