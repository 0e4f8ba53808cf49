"""Registered queries: sources and sinks (S1-S8), profiling and default
analysis (P1-P6), query running and reuse (Q1-Q4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.profile import (
    DIMENSION_HINTS,
    MEASURE_HINTS,
    auto_drilldown,
    auto_summary,
    column_roles,
    histogram,
    merge_sketches,
    profile,
    profile_of,
    roles_from_profile,
    series_extremes,
    sketch_profile,
)
from ..session import checkpointed, scratch_path
from ..sources.files import add_table, load_csv, load_tables, read_csv, read_parquet
from ..sources.snapshot import preview, snapshot, spill
from .catalog import register, round6, table
from .query import Metrics, diff, metric_by, rerun, run_query, run_steps, store_steps

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def driver_views(spark, sf):
    """Register the driver tables as views, for the free-form SQL queries."""
    for t in DRIVER_TABLES:
        table(spark, sf, t).createOrReplaceTempView(t)


@register(
    "S1_csv_roundtrip",
    "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def s1(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return read_csv(spark, path)


@register("S1_csv_quoted_text", "SELECT CAST(doc_id AS INTEGER) AS doc_id, text, lang, source FROM documents")
def s1_text(spark, sf):
    """Whole texts with commas, quotes and line breaks."""
    path = scratch_path(spark, "csv")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    docs.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return read_csv(spark, path)


@register(
    "S1_csv_type_report",
    """
SELECT 'o_orderkey' AS "column", 'int' AS type, count(*) AS "values", 0 AS not_int, count(*) AS not_date FROM orders
UNION ALL SELECT 'code', 'string', count(*), count(*) FILTER (WHERE o_orderkey % 25001 = 1), count(*) FROM orders
UNION ALL SELECT 'o_orderdate', 'date', count(o_orderdate), count(o_orderdate), 0 FROM orders
UNION ALL SELECT 'o_totalprice', 'double', count(*), count(*) FILTER (WHERE CAST(o_totalprice AS VARCHAR) LIKE '%.%' OR abs(o_totalprice) >= 2147483648), count(*) FROM orders
""",
)
def s1_report(spark, sf):
    """A number column with a few dashes far down: text, and the report says why."""
    path = scratch_path(spark, "csv")
    o = table(spark, sf, "orders")
    code = F.when(F.col("o_orderkey") % 25001 == 1, F.lit("-")).otherwise(F.col("o_orderkey").cast("string"))
    o.select("o_orderkey", code.alias("code"), F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_totalprice").write.option("header", True).csv(path)
    return load_csv(spark, path).report.select("column", "type", "values", "not_int", "not_date")


@register("S2_parquet_source", "SELECT * FROM lineitem")
def s2(spark, sf):
    return read_parquet(spark, f"{sf.rstrip('/')}/lineitem.parquet")


@register(
    "S3_load_folder_tables",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in DRIVER_TABLES),
)
def s3(spark, sf):
    tables = load_tables(spark, sf, register=False)
    out = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = c if out is None else out.unionByName(c)
    return out


@register(
    "S5_snapshot_provenance",
    """
SELECT 'orders' AS source, count(*) AS source_row_count, least(count(*), 1000) AS row_count,
       count(*) > 1000 AS truncated FROM orders
""",
)
def s5(spark, sf):
    prov = snapshot(table(spark, sf, "orders"), scratch_path(spark, "snapshot"), max_rows=1000, source="orders")
    return prov.drop("snapshot_at")


@register(
    "S6_spill_result",
    """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_orderstatus = 'O'
) WHERE rn = 1
""",
)
def s6(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderstatus") == "O")
    latest = o.groupBy("o_custkey").agg(
        F.max_by(F.struct("o_orderkey", "o_orderdate", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("r")
    ).select("o_custkey", "r.o_orderkey", "r.o_orderdate", "r.o_totalprice")
    path = spill(latest, scratch_path(spark, "spill"), threshold=200)
    return spark.read.parquet(path) if path else latest


@register(
    "S7_add_table_then_join",
    """
SELECT c.c_mktsegment, count(*) AS orders FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY c.c_mktsegment
""",
)
def s7(spark, sf):
    catalog = load_tables(spark, [f"{sf.rstrip('/')}/orders.parquet"])
    add_table(spark, catalog, f"{sf.rstrip('/')}/customer.parquet")
    return spark.sql(
        "SELECT c.c_mktsegment, count(*) AS orders FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey "
        "GROUP BY c.c_mktsegment"
    )


@register(
    "S8_preview",
    """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT 50
""",
)
def s8(spark, sf):
    return preview(table(spark, sf, "orders").orderBy("o_orderkey"), 50)


_PROFILE_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _profile_sql() -> str:
    parts = []
    for i, c in enumerate(_PROFILE_COLS):
        parts.append(
            f"""SELECT {i} AS ordinal, '{c}' AS "column", count(*) AS row_count,
       CASE WHEN count(*) = 0 THEN 0.0 ELSE ROUND((count(*) - count({c})) / count(*), 4) END AS null_fraction,
       count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max,
       array_to_string(list_sort(list(DISTINCT CAST({c} AS VARCHAR)) FILTER (WHERE {c} IS NOT NULL))[1:5], '|') AS sample_values
FROM orders"""
        )
    return "\nUNION ALL\n".join(parts)


@register("P1_profile", _profile_sql())
def p1(spark, sf):
    prof = profile(table(spark, sf, "orders").select(*_PROFILE_COLS))
    return prof.select(
        "ordinal", "column", "row_count", "null_fraction", "distinct_count", "min", "max",
        F.array_join("sample_values", "|").alias("sample_values"),
    )


@register("P1_profile_of_merged_parts", f'SELECT ordinal, "column", row_count, null_fraction, min, max FROM ({_profile_sql()})')
def p1m(spark, sf):
    """The sketches of two parts of the table, stored and merged."""
    o = table(spark, sf, "orders").select(*_PROFILE_COLS)
    parts = [checkpointed(sketch_profile(o.where(c))) for c in ("o_orderstatus = 'F'", "o_orderstatus <> 'F' OR o_orderstatus IS NULL")]
    return profile_of(merge_sketches(*parts)).select("ordinal", "column", "row_count", "null_fraction", "min", "max")


def _first_column(where: str) -> str:
    return f"(SELECT column_name FROM cols WHERE {where} ORDER BY i LIMIT 1)"


_IS_ID = "regexp_matches(lower(column_name), '(^|_)id($|_)') OR lower(column_name) LIKE '%id'"
_IS_NUMBER = "regexp_matches(column_type, '^(TINYINT|SMALLINT|INTEGER|BIGINT|HUGEINT|FLOAT|DOUBLE|DECIMAL.*)$')"
_MEASURE = f"{_IS_NUMBER} AND NOT ({_IS_ID})"
_HINTED = "regexp_matches(lower(column_name), '{}')"


@register(
    "P2_column_roles",
    f"""
WITH cols AS (SELECT row_number() OVER () AS i, column_name, column_type FROM (DESCRIBE orders))
SELECT 'orders' AS table_name, {_first_column("regexp_matches(column_type, '^(DATE|TIMESTAMP)')")} AS date_column,
  coalesce({_first_column(f"{_MEASURE} AND " + _HINTED.format("|".join(MEASURE_HINTS)))}, {_first_column(_MEASURE)}) AS measure_column,
  coalesce({_first_column(_HINTED.format("|".join(DIMENSION_HINTS)))},
           (SELECT CASE WHEN count(DISTINCT o_orderstatus) <= greatest(1, count(*) // 4) THEN 'o_orderstatus' END FROM orders))
    AS dimension_column
UNION ALL
SELECT 'documents', NULL, 'n_chars',
  CASE WHEN count(DISTINCT text) <= greatest(1, count(*) // 4) THEN 'text'
       WHEN count(DISTINCT lang) <= greatest(1, count(*) // 4) THEN 'lang'
       WHEN count(DISTINCT source) <= greatest(1, count(*) // 4) THEN 'source' END
FROM documents
""",
)
def p2(spark, sf):
    rows = []
    for name in ("orders", "documents"):
        df = table(spark, sf, name)
        roles = roles_from_profile(profile(df), df)
        rows.append((name, roles.date, roles.measure, roles.dimension))
    return spark.createDataFrame(rows, "table_name string, date_column string, measure_column string, dimension_column string")


@register(
    "P3_auto_summary",
    """
SELECT date_trunc('month', o_orderdate) AS month, ROUND(SUM(o_totalprice), 2) AS total_o_totalprice
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1
""",
)
def p3(spark, sf):
    o = table(spark, sf, "orders")
    return auto_summary(o, column_roles(o))


@register(
    "P4_series_extremes",
    """
WITH s AS (SELECT date_trunc('month', o_orderdate) AS month, ROUND(SUM(o_totalprice), 2) AS total
           FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)
SELECT CAST(arg_min(month, (total, month)) AS VARCHAR) AS low_label, min(total) AS low_value,
       CAST(arg_min(month, (-total, month)) AS VARCHAR) AS high_label, max(total) AS high_value,
       CAST(arg_max(month, month) AS VARCHAR) AS last_label, arg_max(total, month) AS last_value,
       ROUND(CASE WHEN max(total) = 0 THEN NULL ELSE (max(total) - min(total)) / abs(max(total)) * 100 END, 6) AS swing_pct
FROM s
""",
)
def p4(spark, sf):
    o = table(spark, sf, "orders")
    s = auto_summary(o, column_roles(o))
    return round6(series_extremes(s, "month", "total_o_totalprice"), {"swing_pct"})


def _orders_customers(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderdate", "o_totalprice", "c_mktsegment", "o_orderstatus")


@register(
    "P5_drilldown_decompositions",
    """
WITH base AS (SELECT c.c_mktsegment AS dim, o.o_totalprice AS meas, o.o_orderdate AS d
              FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
g AS (SELECT COALESCE(CAST(dim AS VARCHAR), 'None') AS value,
        COALESCE(ROUND(SUM(CASE WHEN date_trunc('month', d) = DATE '1999-03-01' THEN meas ELSE 0 END), 2), 0) AS period_a,
        COALESCE(ROUND(SUM(CASE WHEN date_trunc('month', d) = DATE '1999-04-01' THEN meas ELSE 0 END), 2), 0) AS period_b
      FROM base WHERE date_trunc('month', d) IN (DATE '1999-03-01', DATE '1999-04-01') GROUP BY 1),
t AS (SELECT *, ROUND(period_b - period_a, 2) AS delta FROM g),
tot AS (SELECT ROUND(SUM(delta), 2) AS total FROM t)
SELECT 'c_mktsegment' AS dimension, value, period_a, period_b, delta,
       CASE WHEN tot.total = 0 THEN NULL ELSE ROUND(delta / tot.total * 100, 1) END AS contribution_pct
FROM t, tot
""",
)
def p5(spark, sf):
    return auto_drilldown(_orders_customers(spark, sf), "1999-03", "1999-04").decompositions


@register(
    "P5_drilldown_volume_rate",
    """
WITH s AS (SELECT count(*) FILTER (WHERE date_trunc('month', o_orderdate) = DATE '1999-03-01') AS na,
                  count(*) FILTER (WHERE date_trunc('month', o_orderdate) = DATE '1999-04-01') AS nb,
                  COALESCE(SUM(o_totalprice) FILTER (WHERE date_trunc('month', o_orderdate) = DATE '1999-03-01'), 0) AS ta,
                  COALESCE(SUM(o_totalprice) FILTER (WHERE date_trunc('month', o_orderdate) = DATE '1999-04-01'), 0) AS tb
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
e AS (SELECT *, ta / na AS avg_a, tb / nb AS avg_b FROM s)
SELECT ROUND(tb - ta, 2) AS delta_total, na AS orders_a, nb AS orders_b, ROUND(avg_a, 2) AS avg_a, ROUND(avg_b, 2) AS avg_b,
       ROUND((nb - na) * avg_a, 2) AS volume_effect, ROUND((avg_b - avg_a) * na, 2) AS rate_effect,
       ROUND((nb - na) * (avg_b - avg_a), 2) AS interaction,
       CASE WHEN abs((nb - na) * avg_a) >= abs((avg_b - avg_a) * na) THEN 'volume' ELSE 'rate' END AS primary_driver
FROM e
""",
)
def p5v(spark, sf):
    return auto_drilldown(_orders_customers(spark, sf), "1999-03", "1999-04").volume_rate


@register(
    "P6_histogram",
    """
WITH s AS (SELECT count(l_extendedprice) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
k AS (SELECT *, least(20, greatest(5, CASE WHEN n // 2 = 0 THEN 5 ELSE n // 2 END)) AS k FROM s),
b AS (SELECT CAST(CASE WHEN k.hi = k.lo THEN floor(k.k / 2) + 1
                  ELSE least(floor((l.l_extendedprice - k.lo) / (k.hi - k.lo) * k.k) + 1, k.k) END AS INTEGER) AS bin
      FROM lineitem l, k WHERE l.l_extendedprice IS NOT NULL),
c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin),
grid AS (SELECT CAST(g.bin AS INTEGER) AS bin, k.lo, k.hi, k.k FROM k, range(1, k.k + 1) g(bin) WHERE k.n > 0)
SELECT grid.bin, grid.lo + (grid.bin - 1) * ((grid.hi - grid.lo) / grid.k) AS bin_lo,
       CASE WHEN grid.bin = grid.k THEN grid.hi ELSE grid.lo + grid.bin * ((grid.hi - grid.lo) / grid.k) END AS bin_hi,
       COALESCE(c.count, 0) AS count
FROM grid LEFT JOIN c ON grid.bin = c.bin
""",
)
def p6(spark, sf):
    return histogram(table(spark, sf, "lineitem"), "l_extendedprice")


_Q1_SQL = "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey"


@register("Q1_capped_query", _Q1_SQL + " LIMIT 1000")
def q1(spark, sf):
    driver_views(spark, sf)
    return run_query(spark, _Q1_SQL, cap=1000).rows


@register(
    "Q1_truncation_flag",
    f"SELECT CAST(least(count(*), 1000) AS BIGINT) AS row_count, count(*) > 1000 AS truncated FROM ({_Q1_SQL})",
)
def q1f(spark, sf):
    driver_views(spark, sf)
    return run_query(spark, _Q1_SQL, cap=1000).meta


_STEPS = [
    ("s1", "SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue, count(*) AS orders FROM orders GROUP BY o_custkey"),
    (
        "s2",
        "SELECT c.c_mktsegment, count(*) AS customers, CAST(SUM(s.revenue) AS DOUBLE) AS revenue "
        "FROM step_s1 s JOIN customer c ON s.o_custkey = c.c_custkey GROUP BY c.c_mktsegment",
    ),
    (
        "s3",
        "SELECT c_mktsegment, customers, revenue, revenue / customers AS revenue_per_customer FROM step_s2 "
        "WHERE customers > (SELECT count(*) / 10 FROM step_s1)",
    ),
]


@register(
    "Q2_step_composition",
    "WITH step_s1 AS (" + _STEPS[0][1] + "), step_s2 AS (" + _STEPS[1][1] + ") " + _STEPS[2][1],
)
def q2(spark, sf):
    driver_views(spark, sf)
    return run_steps(spark, _STEPS)["s3"]


@register(
    "Q3_rerun_identical",
    f"""
SELECT a AS only_in_first, b AS only_in_second, a = 0 AND b = 0 AS identical
FROM (SELECT (SELECT count(*) FROM ({_STEPS[0][1]} EXCEPT ALL {_STEPS[0][1]})) AS a,
             (SELECT count(*) FROM ({_STEPS[0][1]} EXCEPT ALL {_STEPS[0][1]})) AS b)
""",
)
def q3(spark, sf):
    driver_views(spark, sf)
    return rerun(spark, _STEPS[0][1])


_OPEN_ORDERS = "SELECT * FROM orders WHERE o_orderstatus <> 'F'"


@register(
    "Q3_rerun_after_change",
    f"""
WITH first AS ({_STEPS[0][1]}), again AS ({_STEPS[0][1].replace("FROM orders", f"FROM ({_OPEN_ORDERS}) orders")})
SELECT a AS only_in_first, b AS only_in_second, a = 0 AND b = 0 AS identical
FROM (SELECT (SELECT count(*) FROM (SELECT * FROM first EXCEPT ALL SELECT * FROM again)) AS a,
             (SELECT count(*) FROM (SELECT * FROM again EXCEPT ALL SELECT * FROM first)) AS b)
""",
)
def q3c(spark, sf):
    """The table changes between the stored first run and the second."""
    driver_views(spark, sf)
    first = store_steps(run_steps(spark, _STEPS[:1]))
    spark.sql(_OPEN_ORDERS).createOrReplaceTempView("orders")
    changed = rerun(spark, _STEPS[0][1], first["s1"])
    driver_views(spark, sf)
    return changed


@register(
    "Q3_diff_two_results",
    """
SELECT (SELECT count(*) FROM (SELECT o_orderkey, o_custkey FROM orders WHERE year(o_orderdate) = 1998
                              EXCEPT ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F')) AS only_in_first,
       (SELECT count(*) FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'
                              EXCEPT ALL SELECT o_orderkey, o_custkey FROM orders WHERE year(o_orderdate) = 1998)) AS only_in_second,
       false AS identical
""",
)
def q3d(spark, sf):
    o = table(spark, sf, "orders")
    a = o.where(F.year("o_orderdate") == 1998).select("o_orderkey", "o_custkey")
    b = o.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")
    return diff(a, b)


@register(
    "Q4_named_metrics",
    """
SELECT o_orderstatus, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, COUNT(*) AS orders,
       ROUND(AVG(o_totalprice), 6) AS avg_order_value
FROM orders GROUP BY o_orderstatus
""",
)
def q4(spark, sf):
    m = Metrics()
    m.parse("revenue = CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) | booked value")
    m.parse("orders = COUNT(*) | number of orders")
    m.define("avg_order_value", "AVG(o_totalprice)", "mean order value")
    out = metric_by(table(spark, sf, "orders"), m, ["revenue", "orders", "avg_order_value"], ["o_orderstatus"])
    return round6(out, {"avg_order_value"})
