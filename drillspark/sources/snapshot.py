"""Snapshots with provenance (S5), JDBC import (S4), result spill (S6) and
result preview (S8)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# parameters of a key=value connection string that name a place, not a person
_PLACE_KEYS = ("host", "hostaddr", "port", "dbname", "database")


def redact_dsn(dsn: str) -> str:
    """Where a connection goes, without who goes there: scheme, host, port and
    path of a URL (its user, password, parameters and query are cut off), or
    the host, port and database of a ``key=value`` string."""
    scheme, mark, rest = dsn.rpartition("://") if "://" not in dsn else dsn.partition("://")
    if not mark and "@" not in dsn and "=" in dsn:
        pairs = re.findall(r"(\w+)\s*=\s*('(?:[^'\\\\]|\\\\.)*'|[^\s;&]*)", dsn)
        return " ".join(f"{k}={v}" for k, v in pairs if k.lower() in _PLACE_KEYS)
    authority = re.split(r"[/?#]", rest, maxsplit=1)[0]
    if "@" in authority:  # the user part ends at its last @
        rest = rest[authority.rindex("@") + 1 :]
    else:
        # a password may hold any of / @ ? #: then what looks like the authority is
        # user:password, with no port after the colon, or an @ follows before the query
        path = re.split(r"[?#]", rest, maxsplit=1)[0]
        if "@" in path:
            rest = rest[path.rindex("@") + 1 :]
        elif "@" in rest and not re.fullmatch(r"[^:]*|[^:]*:\d*|\[[^]]*\](:\d*)?", authority.split(";", 1)[0]):
            rest = rest.rpartition("@")[2]
    place = re.split(r"[?#]", rest, maxsplit=1)[0].split(";", 1)[0]
    return f"{scheme}{mark}{place}"


def snapshot(
    df: DataFrame, path: str, max_rows: int | None = None, source: str | None = None, mode: str = "overwrite"
) -> DataFrame:
    """Write a (possibly capped) copy of ``df`` as Parquet and return one
    provenance row: source, snapshot_at, source_row_count, row_count,
    truncated (= the source has more rows than were imported).

    The imported rows are counted as they are written. Without a cap that is the
    source's count, too, and the source is read once; with one, the source is counted
    by its own aggregation (an observation above the limit would stop early and
    under-count).
    """
    spark = df.sparkSession
    written = _write_counted(df.limit(int(max_rows)) if max_rows else df, path, mode)
    source_rows = df.count() if max_rows else written
    schema = "source string, snapshot_at timestamp, source_row_count long, row_count long, truncated boolean"
    return spark.createDataFrame(
        [(redact_dsn(source) if source else path, None, int(source_rows), int(written), source_rows > written)], schema
    ).withColumn("snapshot_at", F.current_timestamp())


def _write_counted(df: DataFrame, path: str, mode: str) -> int:
    """Write ``df`` as Parquet; the number of its rows, observed in the same pass."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
    return seen.get["rows"]


def jdbc_tables(spark: SparkSession, url: str, properties: dict | None = None) -> DataFrame:
    """Base tables of a database outside the system schemas."""
    q = (
        "SELECT table_schema, table_name FROM information_schema.tables "
        "WHERE table_type = 'BASE TABLE' AND table_schema NOT IN ('pg_catalog', 'information_schema')"
    )
    return spark.read.jdbc(url, f"({q}) t", properties=properties or {})


def jdbc_snapshot(
    spark: SparkSession,
    url: str,
    tables: Sequence[str],
    out_dir: str,
    max_rows: int | None = None,
    properties: dict | None = None,
    partition_column: str | None = None,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Copy selected tables to Parquet (one folder per table) and return one
    provenance row per table. A selection is required; all rows are copied
    unless ``max_rows`` says otherwise.

    With a partition column the read is split into ``num_partitions`` range
    queries, between the column's own minimum and maximum unless bounds are
    given. A row cap cannot be combined with a split: every range query would
    apply it by itself."""
    if not tables:
        raise ValueError("no table selected to import")
    if max_rows is not None and partition_column:
        raise ValueError("a row cap and a partitioned read exclude each other")
    props = dict(properties or {})
    rows = []
    for t in tables:
        counted = spark.read.jdbc(url, f"(SELECT count(*) AS n FROM {t}) c", properties=props).first()[0]
        if partition_column:
            low, high = lower_bound, upper_bound
            if low is None or high is None:
                ends = f"(SELECT min({partition_column}) AS a, max({partition_column}) AS b FROM {t}) e"
                found = spark.read.jdbc(url, ends, properties=props).first()
                low, high = (found[0] if low is None else low), (found[1] if high is None else high)
            df = spark.read.jdbc(
                url, t, column=partition_column, lowerBound=low or 0, upperBound=high or 0,
                numPartitions=num_partitions or spark.sparkContext.defaultParallelism, properties=props,
            )
        else:
            src = t if max_rows is None else f"(SELECT * FROM {t} LIMIT {int(max_rows)}) s"
            df = spark.read.jdbc(url, src, properties=props)
        target = f"{out_dir.rstrip('/')}/{t.replace('.', '_')}"
        written = _write_counted(df, target, "overwrite")
        rows.append((t, redact_dsn(url), int(counted), int(written), int(counted) > int(written), target))
    return spark.createDataFrame(
        rows,
        "table string, source string, source_row_count long, row_count long, truncated boolean, path string",
    )


def spill(df: DataFrame, path: str, threshold: int) -> str | None:
    """Write the whole result as Parquet to the new folder ``path`` and return
    the path, or None if it has no more than ``threshold`` rows (the folder is
    then removed again). The result is computed once, by the write, which counts its
    rows."""
    spark = df.sparkSession
    if _write_counted(df, path, "error") > threshold:
        return path
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return None


_PLAIN = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def preview(df: DataFrame, n: int = 50) -> DataFrame:
    """First ``n`` rows with every value that is not a JSON primitive (dates,
    timestamps, decimals, nested and binary values) rendered as text."""
    cols = [
        F.col(f"`{f.name}`") if isinstance(f.dataType, _PLAIN) else F.col(f"`{f.name}`").cast("string").alias(f.name)
        for f in df.schema.fields
    ]
    return df.limit(n).select(*cols)
