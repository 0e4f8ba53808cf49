"""Registered queries: time series of order value."""

from __future__ import annotations

from ..operators.series import growth_rates, moving_average, trend
from .catalog import register, table
from .sqlfrag import t_two_sided_sql

_PERIODS = """
WITH agg AS (SELECT date_trunc('month', o_orderdate) AS period, ROUND(SUM(o_totalprice), 2) AS value
             FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)
"""


@register(
    "T11_moving_average",
    _PERIODS
    + """
SELECT period, value, ROUND(AVG(value) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving_avg
FROM agg
""",
)
def t11(spark, sf):
    return moving_average(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month", 3).table


@register(
    "T12_growth_rates",
    _PERIODS
    + """
SELECT period, value, LAG(value, 12) OVER (ORDER BY period) AS prev,
       ROUND((value - LAG(value, 12) OVER (ORDER BY period)) / NULLIF(LAG(value, 12) OVER (ORDER BY period), 0) * 100, 2)
         AS pct_change
FROM agg
""",
)
def t12(spark, sf):
    return growth_rates(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month", 12).table


@register(
    "T12_growth_metrics",
    _PERIODS
    + """
, g AS (SELECT ROUND((value - LAG(value, 12) OVER (ORDER BY period)) / NULLIF(LAG(value, 12) OVER (ORDER BY period), 0) * 100, 2)
          AS pct_change FROM agg)
SELECT count(*) AS periods, ROUND(avg(pct_change), 2) AS avg_pct_change, 12 AS periods_ago FROM g
""",
)
def t12m(spark, sf):
    return growth_rates(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month", 12).metrics


@register(
    "T13_trend",
    _PERIODS
    + """
, idx AS (SELECT period, value, CAST(row_number() OVER (ORDER BY period) - 1 AS DOUBLE) AS i,
                 value - LAG(value) OVER (ORDER BY period) AS chg FROM agg),
s AS (SELECT count(*) AS periods, regr_slope(value, i) AS slope, coalesce(corr(i, value), 0) AS r,
             arg_min(period, (-abs(chg), i)) FILTER (WHERE chg IS NOT NULL) AS big_at,
             arg_min(chg, (-abs(chg), i)) FILTER (WHERE chg IS NOT NULL) AS big_chg FROM idx),
t AS (SELECT *, r * sqrt((periods - 2) / ((1 - r) * (1 + r))) AS tt FROM s)
SELECT ROUND(slope, 4) AS slope_per_period, ROUND(r * r, 4) AS r_squared,
       ROUND(CASE WHEN abs(r) >= 1 THEN 0.0 ELSE """
    + t_two_sided_sql("tt", "(periods - 2)")
    + """ END, 6) AS p_value,
       CASE WHEN slope > 0 THEN 'rising' WHEN slope < 0 THEN 'falling' ELSE 'flat' END AS direction,
       periods, big_at AS biggest_change_at, ROUND(coalesce(big_chg, 0), 2) AS biggest_change
FROM t
""",
)
def t13(spark, sf):
    return trend(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month").metrics
