"""File sources: CSV (S1), Parquet (S2), folders of files as tables (S3) and
adding a table to an open catalog (S7).

A table is one file (or one Parquet dataset folder), named after it; a folder
stands for the data files directly in it. Listing is one glob on the Hadoop
file system of the path, so local folders, HDFS and object stores behave alike.
"""

from __future__ import annotations

import itertools
import re
from collections import OrderedDict
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed

# every spelling of the data suffixes, for a glob
_DATA_GLOB = "*.{[cC][sS][vV],[pP][aA][rR][qQ][uU][eE][tT],[pP][qQ]}"

# file name -> table name, one rule after the other
_NAME_RULES = (
    (re.compile(r"\.[^.]*$"), ""),
    (re.compile(r"[^a-z0-9_]+"), "_"),
    (re.compile(r"^_+|_+$"), ""),
    (re.compile(r"^$"), "table"),
    (re.compile(r"^(?=[0-9])"), "t_"),
)


# type -> what a value of it looks like; a column gets the first one that all its values fit
_INTEGER, _NUMBER = r"^\s*[+-]?[0-9]+\s*$", r"^\s*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|NaN|[+-]?Infinity)\s*$"
_TYPES = {
    "int": _INTEGER,
    "bigint": _INTEGER,
    "decimal(38,0)": _INTEGER,
    "double": _NUMBER,
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T].*)?$",
    "boolean": r"^(?i)(true|false)$",
}
_RAGGED = "__ragged"


class CsvLoad(NamedTuple):
    rows: DataFrame  # typed, all rows of the file
    report: DataFrame  # a row a column: type, values, and for each type how many do not fit it
    ragged: int  # rows with more or fewer fields than the header


def load_csv(spark: SparkSession, path: str, sep: str = ",", infer: bool = True, multiline: bool | None = None) -> CsvLoad:
    """A CSV file with a header row, as a table, whatever is in it.

    Fields may be quoted, with ``""`` for a quote and line breaks inside. The file is
    parsed once, as text, into a written table. One aggregation over that counts, for
    every column and type, the values that do not fit (missing and empty ones fit
    all); the column gets the first type that all its values fit, in the order int,
    bigint, decimal, double, date, timestamp, boolean, and is text otherwise. So a
    stray ``-`` anywhere in the file makes its column text, and the report says how
    few values stood in the way. A row with more or fewer fields than the header is
    kept, with nulls for what is missing and without what is too much, and counted.

    Without quoted line breaks, which one pass over the lines tells, the file is
    parsed by many tasks; ``multiline`` says so without looking.
    """
    if multiline is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multiline = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    options = {"header": True, "sep": sep, "escape": '"', "multiLine": multiline}
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _RAGGED]])
    raw = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=_RAGGED, enforceSchema=True).schema(schema).csv(path)
    raw = raw.select(*[_quoted(n) for n in names], F.col(_RAGGED).isNotNull().alias(_RAGGED))
    text = checkpointed(raw.toDF(*[f"c{i}" for i in range(len(names))], _RAGGED))
    cells = []
    aggs = [F.count_if(_RAGGED).alias("_ragged")]
    for i in range(len(names)):
        some = F.expr(f"c{i} IS NOT NULL AND c{i} <> ''")
        aggs.append(F.count_if(some).alias(f"_n{i}"))
        for k, (kind, look) in enumerate(_TYPES.items()):
            fits = F.col(f"c{i}").rlike(look) & F.expr(f"try_cast(c{i} AS {kind}) IS NOT NULL")
            aggs.append(F.count_if(some & ~fits).alias(f"_m{i}_{k}"))
    counts = text.agg(*aggs).first()
    made = []
    for i, name in enumerate(names):
        misfits = [counts[f"_m{i}_{k}"] for k in range(len(_TYPES))]
        kind = next((t for t, m in zip(_TYPES, misfits) if not m), "string") if infer and counts[f"_n{i}"] else "string"
        cells.append((i, name, kind, counts[f"_n{i}"], *misfits))
        made.append((F.col(f"c{i}") if kind == "string" else F.expr(f"try_cast(c{i} AS {kind})")).alias(name))
    columns = ["ordinal int", "column string", "type string", "values long"]
    columns += [f"not_{t.partition('(')[0]} long" for t in _TYPES]
    report = spark.createDataFrame(cells, ", ".join(columns))
    return CsvLoad(text.select(*made), report, counts["_ragged"])


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", infer: bool = True, multiline: bool | None = None, ragged: str = "fail"
) -> DataFrame:
    """The rows of ``load_csv``. Rows that do not fit the header fail the read, unless
    ``ragged`` is "keep"."""
    loaded = load_csv(spark, path, sep, infer, multiline)
    if loaded.ragged and ragged != "keep":
        raise ValueError(f"{loaded.ragged} rows of {path} have more or fewer fields than its header")
    return loaded.rows


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with its own schema."""
    return spark.read.parquet(path)


_READERS = {"csv": read_csv, "parquet": read_parquet, "pq": read_parquet}


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Read a data file by its suffix."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in _READERS:
        raise ValueError(f"cannot tell the format of {path!r}: known suffixes are {', '.join(sorted(_READERS))}")
    return _READERS[suffix](spark, path)


def table_name(file_name: str, existing: Iterable[str] = ()) -> str:
    """Table name for a file: its lower-case stem with ``_`` for runs of other
    characters, ``t_`` before a leading digit, ``table`` if nothing is left; a
    taken name gets the first free number from 2."""
    name = file_name.rstrip("/").rpartition("/")[2].lower()
    for pattern, text in _NAME_RULES:
        name = pattern.sub(text, name)
    numbered = (f"{name}_{i}" for i in itertools.count(2))
    taken = frozenset(existing)
    return next(n for n in itertools.chain([name], numbered) if n not in taken)


def _data_files(spark: SparkSession, given: str) -> dict[str, str]:
    """Qualified path -> path as shown, of the data files ``given`` stands for."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(given)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole_table = given.rstrip("/").lower().endswith((".parquet", ".pq"))
    if whole_table or not (fs.exists(path) and fs.getFileStatus(path).isDirectory()):
        return {str(fs.makeQualified(path)): given}
    escaped = re.sub(r"([\\\[\]{}*?])", r"\\\1", given.rstrip("/"))
    found = fs.globStatus(hadoop.Path(f"{escaped}/{_DATA_GLOB}")) or []
    # a folder may be a Parquet dataset, but not a CSV file
    found = [s.getPath() for s in found if s.isFile() or not s.getPath().getName().lower().endswith(".csv")]
    if not found:
        raise ValueError(f"folder {given!r} holds no CSV or Parquet data")
    return {str(fs.makeQualified(p)): p.toString() for p in sorted(found, key=lambda p: p.getName())}


def expand_sources(spark: SparkSession, paths: str | Iterable[str]) -> list[str]:
    """The data files that ``paths`` stand for, in order, each once: folders
    are replaced by the data files in them (not in their folders), by name."""
    shown: dict[str, str] = {}
    for given in [paths] if isinstance(paths, str) else paths:
        for qualified, path in _data_files(spark, given).items():
            shown.setdefault(qualified, path)
    return list(shown.values())


def load_tables(spark: SparkSession, paths: str | Iterable[str], register: bool = True) -> "OrderedDict[str, DataFrame]":
    """Load every source as its own table, in order (the first is the primary
    table); register each as a temporary view so SQL can join them."""
    tables: OrderedDict[str, DataFrame] = OrderedDict()
    for path in expand_sources(spark, paths):
        name = table_name(path, tables)
        tables[name] = read_file(spark, path)
        if register:
            tables[name].createOrReplaceTempView(name)
    return tables


def add_table(spark: SparkSession, catalog: "OrderedDict[str, DataFrame] | dict", path: str, name: str | None = None) -> str:
    """Add one more file to an open catalog; later SQL can join it."""
    name = name or table_name(path, catalog)
    catalog[name] = read_file(spark, path)
    catalog[name].createOrReplaceTempView(name)
    return name
