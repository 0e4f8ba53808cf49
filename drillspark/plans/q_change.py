"""Registered queries: change between two months."""

from __future__ import annotations

from ..operators.change import decompose_contribution, volume_vs_rate
from .catalog import register, table

# Driver inputs: orders joined to customer, segment as dimension.
PERIOD_A, PERIOD_B = "1998-05", "1998-06"

_T3_BASE = """
WITH base AS (
  SELECT c.c_mktsegment AS dim, o.o_totalprice AS meas, o.o_orderdate AS d
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
), g AS (
  SELECT COALESCE(CAST(dim AS VARCHAR), 'None') AS value,
         COALESCE(ROUND(SUM(CASE WHEN date_trunc('month', d) = DATE '1998-05-01' THEN meas ELSE 0 END), 2), 0) AS period_a,
         COALESCE(ROUND(SUM(CASE WHEN date_trunc('month', d) = DATE '1998-06-01' THEN meas ELSE 0 END), 2), 0) AS period_b
  FROM base
  WHERE date_trunc('month', d) IN (DATE '1998-05-01', DATE '1998-06-01')
  GROUP BY 1
), t AS (
  SELECT *, ROUND(period_b - period_a, 2) AS delta FROM g
), tot AS (SELECT ROUND(SUM(delta), 2) AS total FROM t)
"""


def _orders_by_segment(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("c_mktsegment", "o_totalprice", "o_orderdate")


@register(
    "T3_decompose_contribution",
    _T3_BASE
    + """
SELECT value, period_a, period_b, delta,
       CASE WHEN tot.total = 0 THEN NULL ELSE ROUND(delta / tot.total * 100, 1) END AS contribution_pct
FROM t, tot
""",
)
def t3_table(spark, sf):
    return decompose_contribution(
        _orders_by_segment(spark, sf), "c_mktsegment", "o_totalprice", "o_orderdate", PERIOD_A, PERIOD_B
    ).table


@register(
    "T3_decompose_metrics",
    _T3_BASE
    + """
SELECT tot.total AS total_delta,
       arg_min(value, (-abs(delta), value)) AS top_contributor,
       arg_min(CASE WHEN tot.total = 0 THEN NULL ELSE ROUND(delta / tot.total * 100, 1) END,
               (-abs(delta), value)) AS top_contribution_pct
FROM t, tot GROUP BY tot.total
""",
)
def t3_metrics(spark, sf):
    return decompose_contribution(
        _orders_by_segment(spark, sf), "c_mktsegment", "o_totalprice", "o_orderdate", PERIOD_A, PERIOD_B
    ).metrics


@register(
    "T4_volume_vs_rate",
    """
WITH s AS (
  SELECT count(*) FILTER (WHERE date_trunc('month', o_orderdate) = DATE '1998-05-01') AS na,
         count(*) FILTER (WHERE date_trunc('month', o_orderdate) = DATE '1998-06-01') AS nb,
         COALESCE(SUM(o_totalprice) FILTER (WHERE date_trunc('month', o_orderdate) = DATE '1998-05-01'), 0) AS ta,
         COALESCE(SUM(o_totalprice) FILTER (WHERE date_trunc('month', o_orderdate) = DATE '1998-06-01'), 0) AS tb
  FROM orders
), e AS (
  SELECT *, ta / na AS avg_a, tb / nb AS avg_b FROM s
)
SELECT ROUND(tb - ta, 2) AS delta_total, na AS orders_a, nb AS orders_b,
       ROUND(avg_a, 2) AS avg_a, ROUND(avg_b, 2) AS avg_b,
       ROUND((nb - na) * avg_a, 2) AS volume_effect,
       ROUND((avg_b - avg_a) * na, 2) AS rate_effect,
       ROUND((nb - na) * (avg_b - avg_a), 2) AS interaction,
       CASE WHEN abs((nb - na) * avg_a) >= abs((avg_b - avg_a) * na) THEN 'volume' ELSE 'rate' END AS primary_driver
FROM e
""",
)
def t4(spark, sf):
    return volume_vs_rate(table(spark, sf, "orders"), "o_totalprice", "o_orderdate", PERIOD_A, PERIOD_B)
