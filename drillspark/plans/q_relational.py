"""Registered queries: the relational surface of free-form analysis SQL
(R1-R21), written with the DataFrame API, each with its SQL twin.

Money sums are taken in DECIMAL on both sides so the rounded result does not
depend on the order in which two engines add doubles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import truncate
from ..functions.numeric import dround
from ..functions.ranks import exact_quantiles
from ..operators.relational import as_of_join, flag_membership, latest_as_of, ordered_window, totals_as_of, totals_at_cutoffs
from .catalog import register, round6, table


def _dec(c):
    return F.col(c).cast("decimal(18,2)")


def _money(expr):
    """ROUND(SUM(decimal expr), 2) as double."""
    return F.round(F.sum(expr), 2).cast("double")


@register(
    "R1_projection_arithmetic",
    """
SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount), 2) AS net,
       ROUND(l_extendedprice * (1 - l_discount) * (1 + l_tax), 2) AS gross, l_quantity * 2 AS double_qty
FROM lineitem
""",
)
def r1(spark, sf):
    li = table(spark, sf, "lineitem")
    net = F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))
    return li.select(
        "l_orderkey",
        "l_linenumber",
        dround(net, 2).alias("net"),
        dround(net * (F.lit(1) + F.col("l_tax")), 2).alias("gross"),
        (F.col("l_quantity") * 2).alias("double_qty"),
    )


@register(
    "R2_filters",
    """
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part
WHERE p_size BETWEEN 10 AND 30 AND p_type IN ('ECONOMY', 'SMALL') AND p_name LIKE '%bolt%'
  AND p_name NOT LIKE 'red%' AND p_retailprice > 950 AND p_brand IS NOT NULL AND NOT (p_brand = 'Brand#1')
""",
)
def r2(spark, sf):
    p = table(spark, sf, "part")
    return p.where(
        F.col("p_size").between(10, 30)
        & F.col("p_type").isin("ECONOMY", "SMALL")
        & F.col("p_name").like("%bolt%")
        & ~F.col("p_name").like("red%")
        & (F.col("p_retailprice") > 950)
        & F.col("p_brand").isNotNull()
        & ~(F.col("p_brand") == "Brand#1")
    ).select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@register(
    "R3_inner_join_3way",
    """
SELECT c.c_mktsegment, count(*) AS lines,
       CAST(ROUND(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,2)))), 2) AS DOUBLE) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY c.c_mktsegment
""",
)
def r3(spark, sf):
    li, o, c = table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "customer")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return j.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("lines"),
        _money(_dec("l_extendedprice") * (F.lit(1) - _dec("l_discount"))).alias("revenue"),
    )


@register(
    "R4_left_join_aggregates",
    """
SELECT c.c_custkey, c.c_name, COALESCE(a.n_orders, 0) AS n_orders, COALESCE(a.total, 0.0) AS total
FROM customer c LEFT JOIN (
  SELECT o_custkey, count(*) AS n_orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
  FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '2000-01-01' GROUP BY o_custkey
) a ON c.c_custkey = a.o_custkey
""",
)
def r4(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    a = (
        o.where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")))
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n_orders"), F.sum(_dec("o_totalprice")).cast("double").alias("total"))
    )
    return c.join(a, c.c_custkey == a.o_custkey, "left").select(
        "c_custkey",
        "c_name",
        F.coalesce("n_orders", F.lit(0)).alias("n_orders"),
        F.coalesce("total", F.lit(0.0)).alias("total"),
    )


@register(
    "R5_anti_join",
    """
SELECT p.p_partkey, p.p_name FROM part p
LEFT JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45) l ON p.p_partkey = l.l_partkey
WHERE l.l_partkey IS NULL
""",
)
def r5(spark, sf):
    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    big = li.where(F.col("l_quantity") >= 45)
    return p.join(big, p.p_partkey == big.l_partkey, "left_anti").select("p_partkey", "p_name")


@register(
    "R5_anti_join_suppliers",
    """
SELECT s_suppkey, s_name FROM supplier s
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_shipdate >= DATE '2001-11-01')
""",
)
def r5s(spark, sf):
    s, li = table(spark, sf, "supplier"), table(spark, sf, "lineitem")
    recent = li.where(F.col("l_shipdate") >= F.lit("2001-11-01").cast("timestamp_ntz"))
    return s.join(recent, s.s_suppkey == recent.l_suppkey, "left_anti").select("s_suppkey", "s_name")


@register(
    "R6_semi_join",
    """
SELECT o_orderstatus, count(*) AS orders FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
GROUP BY o_orderstatus
""",
)
def r6(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    b = c.where(F.col("c_mktsegment") == "BUILDING")
    return (
        o.join(b, o.o_custkey == b.c_custkey, "left_semi")
        .groupBy("o_orderstatus")
        .agg(F.count(F.lit(1)).alias("orders"))
    )


@register(
    "R6_in_inside_case",
    """
SELECT CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'building'
            ELSE 'other' END AS segment_flag,
       count(*) AS orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders GROUP BY 1
""",
)
def r6c(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    b = c.where(F.col("c_mktsegment") == "BUILDING")
    flagged = flag_membership(o, "o_custkey", b, "c_custkey", "segment_flag", "building", "other")
    return flagged.groupBy("segment_flag").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(_dec("o_totalprice")).cast("double").alias("total")
    )


_CUTOFFS = ["2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29"]


@register(
    "R7_range_join_cutoffs",
    """
SELECT c.cutoff, count(e.event_id) AS events, COALESCE(CAST(SUM(CAST(e.value AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS total_value
FROM (VALUES (TIMESTAMP '2024-01-08'), (TIMESTAMP '2024-01-15'), (TIMESTAMP '2024-01-22'), (TIMESTAMP '2024-01-29')) c(cutoff)
LEFT JOIN events e ON e.ts <= c.cutoff
GROUP BY c.cutoff
""",
)
def r7(spark, sf):
    e = table(spark, sf, "events")
    return totals_at_cutoffs(
        e,
        "ts",
        _CUTOFFS,
        {"events": F.count(F.lit(1)), "total_value": F.sum(_dec("value"))},
    ).select("cutoff", "events", F.col("total_value").cast("double").alias("total_value"))


@register(
    "R8_asof_latest_per_key",
    """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice,
         ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01'
) WHERE rn = 1
""",
)
def r8(spark, sf):
    o = table(spark, sf, "orders")
    return latest_as_of(o, "o_custkey", "o_orderdate", ["1998-01-01"], ["o_orderkey", "o_totalprice"], ["o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"
    )


@register(
    "R8_asof_each_cutoff",
    """
WITH c AS (SELECT * FROM (VALUES (TIMESTAMP '1996-01-01'), (TIMESTAMP '1998-01-01'), (TIMESTAMP '2000-01-01')) v(cutoff))
SELECT cutoff, o_custkey, o_orderdate, o_orderkey, o_totalprice FROM (
  SELECT c.cutoff, o.o_custkey, o.o_orderkey, o.o_orderdate, o.o_totalprice,
         ROW_NUMBER() OVER (PARTITION BY c.cutoff, o.o_custkey ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS rn
  FROM orders o JOIN c ON o.o_orderdate <= c.cutoff
) WHERE rn = 1
""",
)
def r8c(spark, sf):
    o = table(spark, sf, "orders")
    return latest_as_of(
        o, "o_custkey", "o_orderdate", ["1996-01-01", "1998-01-01", "2000-01-01"], ["o_orderkey", "o_totalprice"], ["o_orderkey"]
    )


def _cutoff_pairs(spark, sf):
    """(o_custkey, cutoff, event_id): a table of cut-offs, from each user's events. Events
    are some twenty-five years after the first orders, so their time is moved back by
    the days of the event's number."""
    e = table(spark, sf, "events")
    day = F.date_sub(F.col("ts").cast("date"), (F.col("event_id") % 3000).cast("int"))
    return e.select(F.col("user_id").alias("o_custkey"), day.cast("timestamp").alias("cutoff"), "event_id")


_CUTOFF_PAIRS = (
    "SELECT user_id AS o_custkey, CAST(CAST(ts AS DATE) - CAST(event_id % 3000 AS INTEGER) AS TIMESTAMP) AS cutoff, event_id FROM events"
)


@register(
    "R8_asof_join_table_of_cutoffs",
    f"""
WITH c AS ({_CUTOFF_PAIRS})
SELECT c.o_custkey, c.cutoff, c.event_id, o.o_orderkey, o.o_orderdate FROM c LEFT JOIN (
  SELECT c.event_id, o.o_orderkey, o.o_orderdate,
         ROW_NUMBER() OVER (PARTITION BY c.event_id ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS rn
  FROM c JOIN orders o ON o.o_custkey = c.o_custkey AND o.o_orderdate <= c.cutoff
) o ON o.event_id = c.event_id AND o.rn = 1
""",
)
def r8j(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate"))
    return as_of_join(_cutoff_pairs(spark, sf), o, ["o_custkey"], "cutoff", "o_orderdate", ["o_orderkey", "o_orderdate"], ["o_orderkey"])


@register(
    "R7_range_join_table_of_cutoffs",
    f"""
WITH c AS ({_CUTOFF_PAIRS})
SELECT c.o_custkey, c.cutoff, c.event_id, count(o.o_orderkey) AS orders, COALESCE(SUM(CAST(ROUND(o.o_totalprice * 100) AS BIGINT)), 0)::BIGINT AS cents
FROM c LEFT JOIN orders o ON o.o_custkey = c.o_custkey AND o.o_orderdate <= c.cutoff
GROUP BY c.o_custkey, c.cutoff, c.event_id
""",
)
def r7j(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    sums = {"orders": F.lit(1).cast("long"), "cents": F.col("cents")}
    return totals_as_of(_cutoff_pairs(spark, sf), o, ["o_custkey"], "cutoff", "o_orderdate", sums)


_BUCKET_SQL = (
    "CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' "
    "WHEN o_totalprice >= 150000 THEN 'high' END"
)


@register(
    "R9_group_by_case_buckets",
    f"""
SELECT year(o_orderdate) AS yr, {_BUCKET_SQL} AS bucket, count(*) AS orders,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders GROUP BY 1, 2
""",
)
def r9(spark, sf):
    o = table(spark, sf, "orders")
    p = F.col("o_totalprice")
    bucket = F.when(p < 50000, "low").when(p < 150000, "mid").when(p >= 150000, "high")
    return o.groupBy(F.year("o_orderdate").cast("long").alias("yr"), bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum(_dec("o_totalprice")).cast("double").alias("total")
    )


@register(
    "R10_conditional_aggregates",
    """
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f,
       ROUND(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 2) AS pct_f,
       CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS open_value
FROM orders GROUP BY o_orderpriority
""",
)
def r10(spark, sf):
    o = table(spark, sf, "orders")
    is_f = F.col("o_orderstatus") == "F"
    return o.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(is_f, F.lit(1))).alias("n_f"),
        dround(F.lit(100.0) * F.count(F.when(is_f, F.lit(1))) / F.count(F.lit(1)), 2).alias("pct_f"),
        F.sum(F.when(F.col("o_orderstatus") == "O", _dec("o_totalprice")).otherwise(F.lit(0).cast("decimal(18,2)")))
        .cast("double")
        .alias("open_value"),
    )


@register(
    "R11_aggregate_functions",
    """
SELECT l_returnflag, count(*) AS n, count(l_shipdate) AS n_shipdate, count(DISTINCT l_suppkey) AS suppliers,
       SUM(l_quantity) AS qty, ROUND(avg(l_quantity), 6) AS avg_qty, min(l_extendedprice) AS min_price,
       max(l_extendedprice) AS max_price, ROUND(stddev_samp(l_extendedprice), 6) AS sd_price,
       ROUND(median(l_extendedprice), 6) AS median_price, ROUND(quantile_cont(l_extendedprice, 0.9), 6) AS p90_price,
       ROUND(corr(l_quantity, l_extendedprice), 6) AS corr_qty_price
FROM lineitem GROUP BY l_returnflag
""",
)
def r11(spark, sf):
    li = table(spark, sf, "lineitem")
    base = li.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("l_shipdate").alias("n_shipdate"),
        F.countDistinct("l_suppkey").alias("suppliers"),
        F.sum("l_quantity").alias("qty"),
        F.avg("l_quantity").alias("avg_qty"),
        F.min("l_extendedprice").alias("min_price"),
        F.max("l_extendedprice").alias("max_price"),
        F.stddev_samp("l_extendedprice").alias("sd_price"),
        F.corr("l_quantity", "l_extendedprice").alias("corr_qty_price"),
    )
    q = exact_quantiles(li, "l_extendedprice", [0.5, 0.9], "q", by=["l_returnflag"]).select(
        F.col("l_returnflag").alias("_f"), F.col("q0").alias("median_price"), F.col("q1").alias("p90_price")
    )
    out = base.join(q, base.l_returnflag.eqNullSafe(q._f)).drop("_f")
    return round6(out, {"avg_qty", "sd_price", "median_price", "p90_price", "corr_qty_price"})


@register(
    "R12_scalar_subquery",
    """
SELECT o_orderstatus, count(*) AS above_avg FROM orders
WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) GROUP BY o_orderstatus
""",
)
def r12(spark, sf):
    o = table(spark, sf, "orders")
    avg = o.agg(F.avg("o_totalprice").alias("_avg"))
    return (
        o.crossJoin(F.broadcast(avg))
        .where(F.col("o_totalprice") > F.col("_avg"))
        .groupBy("o_orderstatus")
        .agg(F.count(F.lit(1)).alias("above_avg"))
    )


@register(
    "R13_cte_nested",
    """
WITH cust AS (
  SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue FROM orders GROUP BY o_custkey
), nat AS (
  SELECT n.n_name, count(*) AS customers, SUM(cust.revenue) AS revenue
  FROM cust JOIN customer c ON cust.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY n.n_name
)
SELECT n_name, customers, CAST(revenue AS DOUBLE) AS revenue FROM nat
WHERE revenue > (SELECT avg(revenue) FROM nat)
""",
)
def r13(spark, sf):
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    cust = o.groupBy("o_custkey").agg(F.sum(_dec("o_totalprice")).alias("revenue"))
    nat = (
        cust.join(c, cust.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .groupBy("n_name")
        .agg(F.count(F.lit(1)).alias("customers"), F.sum("revenue").alias("revenue"))
    )
    avg = nat.agg(F.avg("revenue").alias("_avg"))
    return (
        nat.crossJoin(F.broadcast(avg))
        .where(F.col("revenue") > F.col("_avg"))
        .select("n_name", "customers", F.col("revenue").cast("double").alias("revenue"))
    )


@register(
    "R14_windows",
    """
SELECT o_custkey, o_orderkey,
       CAST(ROW_NUMBER() OVER w AS BIGINT) AS rn,
       LAG(o_totalprice) OVER w AS prev_price,
       ROUND(AVG(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving_avg,
       CAST(NTILE(4) OVER w AS BIGINT) AS quartile
FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""",
)
def r14(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    order = [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()]
    w = ordered_window(o, ["o_custkey"], order, "o_totalprice", ntile=4, frames={"avg3": (F.avg, 2)})
    return w.select(
        "o_custkey",
        "o_orderkey",
        F.col("rn").cast("long").alias("rn"),
        F.col("lag1").alias("prev_price"),
        dround("avg3", 6).alias("moving_avg"),
        F.col("ntile").alias("quartile"),
    )


@register(
    "R15_order_by_limit",
    """
SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS orders
FROM orders GROUP BY o_custkey ORDER BY revenue DESC NULLS LAST, o_custkey ASC LIMIT 10
""",
)
def r15(spark, sf):
    o = table(spark, sf, "orders")
    return (
        o.groupBy("o_custkey")
        .agg(F.sum(_dec("o_totalprice")).cast("double").alias("revenue"), F.count(F.lit(1)).alias("orders"))
        .orderBy(F.col("revenue").desc_nulls_last(), F.col("o_custkey").asc())
        .limit(10)
    )


@register(
    "R16_union_all",
    """
SELECT c_nationkey AS nationkey, 'customer' AS src FROM customer
UNION ALL SELECT s_nationkey, 'supplier' FROM supplier
""",
)
def r16a(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return c.select(F.col("c_nationkey").alias("nationkey"), F.lit("customer").alias("src")).unionByName(
        s.select(F.col("s_nationkey").alias("nationkey"), F.lit("supplier").alias("src"))
    )


@register(
    "R16_union_distinct",
    "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier",
)
def r16u(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return c.select(F.col("c_nationkey").alias("nationkey")).union(s.select("s_nationkey")).distinct()


@register(
    "R16_intersect",
    """
SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal < 0
INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000
""",
)
def r16i(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return (
        c.where(F.col("c_acctbal") < 0)
        .select(F.col("c_nationkey").alias("nationkey"))
        .intersect(s.where(F.col("s_acctbal") > 5000).select("s_nationkey"))
    )


@register(
    "R16_except",
    "SELECT n_nationkey AS nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000",
)
def r16e(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    return n.select(F.col("n_nationkey").alias("nationkey")).subtract(
        s.where(F.col("s_acctbal") > 9000).select("s_nationkey")
    )


@register("R17_select_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def r17(spark, sf):
    return table(spark, sf, "customer").select("c_nationkey", "c_mktsegment").distinct()


@register(
    "R18_values_unnest_make_date",
    """
WITH targets AS (SELECT * FROM (VALUES ('BUILDING', 1000000.0), ('AUTOMOBILE', 900000.0), ('MACHINERY', 800000.0)) t(segment, target)),
months AS (SELECT make_date(1998, m, 1) AS month FROM (SELECT unnest([1, 2, 3, 4, 5, 6]) AS m))
SELECT t.segment, m.month, t.target,
       CAST(COALESCE(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS actual
FROM targets t CROSS JOIN months m
LEFT JOIN (SELECT o.o_totalprice, o.o_orderdate, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) o
  ON o.c_mktsegment = t.segment AND CAST(date_trunc('month', o.o_orderdate) AS DATE) = m.month
GROUP BY t.segment, m.month, t.target
""",
)
def r18(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    targets = spark.createDataFrame(
        [("BUILDING", 1000000.0), ("AUTOMOBILE", 900000.0), ("MACHINERY", 800000.0)], "segment string, target double"
    )
    months = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in range(1, 7)])).alias("m")).select(
        F.make_date(F.lit(1998), F.col("m"), F.lit(1)).alias("month")
    )
    grid = targets.crossJoin(F.broadcast(months))  # 3 literal targets x 6 literal months
    lo, hi = F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1998-07-01").cast("timestamp_ntz")
    actual = (
        o.where((F.col("o_orderdate") >= lo) & (F.col("o_orderdate") < hi))
        .join(c, o.o_custkey == c.c_custkey)
        .groupBy(F.col("c_mktsegment").alias("segment"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"))
        .agg(F.sum(_dec("o_totalprice")).alias("actual"))
    )
    return grid.join(actual, ["segment", "month"], "left").select(
        "segment", "month", "target", F.coalesce(F.col("actual"), F.lit(0).cast("decimal(28,2)")).cast("double").alias("actual")
    )


@register(
    "R19_strings_regexp",
    """
SELECT event_id, event_type || ':' || CAST(user_id AS VARCHAR) AS label,
       CAST(regexp_extract(props, '-?[0-9]+(\\.[0-9]+)?', 0) AS DOUBLE) AS k_value,
       upper(event_type) AS kind, length(props) AS props_len
FROM events
""",
)
def r19(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        F.concat(F.col("event_type"), F.lit(":"), F.col("user_id").cast("string")).alias("label"),
        F.regexp_extract("props", r"-?[0-9]+(\.[0-9]+)?", 0).cast("double").alias("k_value"),
        F.upper("event_type").alias("kind"),
        F.length("props").cast("long").alias("props_len"),
    )


@register(
    "R20_date_trunc_grains",
    """
SELECT 'day' AS grain, count(DISTINCT date_trunc('day', o_orderdate)) AS periods, min(date_trunc('day', o_orderdate)) AS first_period FROM orders
UNION ALL SELECT 'week', count(DISTINCT date_trunc('week', o_orderdate)), min(date_trunc('week', o_orderdate)) FROM orders
UNION ALL SELECT 'month', count(DISTINCT date_trunc('month', o_orderdate)), min(date_trunc('month', o_orderdate)) FROM orders
UNION ALL SELECT 'quarter', count(DISTINCT date_trunc('quarter', o_orderdate)), min(date_trunc('quarter', o_orderdate)) FROM orders
UNION ALL SELECT 'year', count(DISTINCT date_trunc('year', o_orderdate)), min(date_trunc('year', o_orderdate)) FROM orders
""",
)
def r20(spark, sf):
    o = table(spark, sf, "orders")
    dt = o.schema["o_orderdate"].dataType
    grains = ["day", "week", "month", "quarter", "year"]
    # every grain follows from the distinct days, far fewer rows than the table has
    days = o.select(truncate("o_orderdate", "day", dt).alias("day")).distinct()
    aggs = []
    for g in grains:
        t = truncate("day", g, dt)
        aggs += [F.countDistinct(t).alias(f"n_{g}"), F.min(t).alias(f"f_{g}")]
    wide = days.agg(*aggs)
    stack = ", ".join(f"'{g}', n_{g}, f_{g}" for g in grains)
    return wide.select(F.expr(f"stack({len(grains)}, {stack}) AS (grain, periods, first_period)"))


@register(
    "R20_date_diff",
    """
SELECT year(o.o_orderdate) AS yr, count(*) AS lines,
       ROUND(avg(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE))), 6) AS avg_ship_days,
       max(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE))) AS max_ship_days
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1
""",
)
def r20d(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    d = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    out = (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .groupBy(F.year("o_orderdate").cast("long").alias("yr"))
        .agg(F.count(F.lit(1)).alias("lines"), F.avg(d).alias("avg_ship_days"), F.max(d).cast("long").alias("max_ship_days"))
    )
    return round6(out, {"avg_ship_days"})


@register(
    "R21_nullif_coalesce",
    """
SELECT n.n_name, count(c.c_custkey) AS customers,
       count(*) FILTER (WHERE c.c_acctbal < 0) AS negative,
       ROUND(count(*) FILTER (WHERE c.c_acctbal < 0) / NULLIF(count(*) FILTER (WHERE c.c_acctbal >= 9000), 0), 4) AS neg_per_rich,
       COALESCE(ROUND(count(*) FILTER (WHERE c.c_acctbal < 0) / NULLIF(count(*) FILTER (WHERE c.c_acctbal >= 9000), 0), 4), 0.0) AS neg_per_rich_or_zero
FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name
""",
)
def r21(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    j = n.join(c, c.c_nationkey == n.n_nationkey, "left")
    neg = F.count(F.when(F.col("c_acctbal") < 0, F.lit(1)))
    rich = F.count(F.when(F.col("c_acctbal") >= 9000, F.lit(1)))
    ratio = dround(F.try_divide(neg, F.nullif(rich, F.lit(0))), 4)
    return j.groupBy("n_name").agg(
        F.count("c_custkey").alias("customers"),
        neg.alias("negative"),
        ratio.alias("neg_per_rich"),
        F.coalesce(ratio, F.lit(0.0)).alias("neg_per_rich_or_zero"),
    )
