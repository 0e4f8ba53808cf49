"""Registered queries: cohorts, funnel and RFM."""

from __future__ import annotations

from ..operators.customers import cohort_retention, funnel, rfm
from .catalog import register, table

_COHORT = """
WITH first AS (SELECT user_id AS ent, MIN(date_trunc('week', ts)) AS cohort FROM events
               WHERE ts IS NOT NULL AND user_id IS NOT NULL GROUP BY 1),
act AS (SELECT DISTINCT user_id AS ent, date_trunc('week', ts) AS period FROM events
        WHERE ts IS NOT NULL AND user_id IS NOT NULL),
c AS (SELECT f.cohort, date_diff('week', f.cohort, a.period) AS period_offset, COUNT(DISTINCT a.ent) AS active
      FROM first f JOIN act a ON f.ent = a.ent GROUP BY 1, 2),
t AS (SELECT c.*, CASE WHEN s.active IS NULL OR s.active = 0 THEN NULL ELSE ROUND(c.active * 100.0 / s.active, 1) END
             AS retention_pct
      FROM c LEFT JOIN (SELECT cohort, active FROM c WHERE period_offset = 0) s ON c.cohort = s.cohort)
"""


@register("T16_cohort_retention", _COHORT + "SELECT cohort, period_offset, active, retention_pct FROM t")
def t16(spark, sf):
    return cohort_retention(table(spark, sf, "events"), "user_id", "ts", "week").table


@register(
    "T16_cohort_metrics",
    _COHORT
    + """
SELECT count(*) FILTER (WHERE period_offset = 0) AS cohorts,
       ROUND(avg(retention_pct) FILTER (WHERE period_offset = 1), 1) AS avg_next_period_retention_pct FROM t
""",
)
def t16m(spark, sf):
    return cohort_retention(table(spark, sf, "events"), "user_id", "ts", "week").metrics


_FUNNEL = """
WITH steps AS (SELECT * FROM (VALUES (0, 'view'), (1, 'click'), (2, 'purchase')) v(step_idx, step)),
c AS (SELECT CAST(event_type AS VARCHAR) AS step, COUNT(DISTINCT user_id) AS entities FROM events
      WHERE CAST(event_type AS VARCHAR) IN ('view', 'click', 'purchase') GROUP BY 1),
j AS (SELECT s.step_idx, s.step, COALESCE(c.entities, 0) AS entities FROM steps s LEFT JOIN c ON s.step = c.step),
t AS (SELECT step_idx, step, entities,
        CASE WHEN LAG(entities) OVER (ORDER BY step_idx) IS NULL OR LAG(entities) OVER (ORDER BY step_idx) = 0 THEN NULL
             ELSE ROUND(entities * 100.0 / LAG(entities) OVER (ORDER BY step_idx), 1) END AS pct_of_prev,
        CASE WHEN FIRST_VALUE(entities) OVER (ORDER BY step_idx) = 0 THEN NULL
             ELSE ROUND(entities * 100.0 / FIRST_VALUE(entities) OVER (ORDER BY step_idx), 1) END AS pct_of_start
      FROM j)
"""


@register("T17_funnel", _FUNNEL + "SELECT * FROM t")
def t17(spark, sf):
    return funnel(table(spark, sf, "events"), "user_id", "event_type", ["view", "click", "purchase"]).table


@register(
    "T17_funnel_metrics",
    _FUNNEL
    + """
SELECT max(entities) FILTER (WHERE step_idx = 0) AS start_entities, max(entities) FILTER (WHERE step_idx = 2) AS end_entities,
       max(pct_of_start) FILTER (WHERE step_idx = 2) AS overall_conversion_pct FROM t
""",
)
def t17m(spark, sf):
    return funnel(table(spark, sf, "events"), "user_id", "event_type", ["view", "click", "purchase"]).metrics


_RFM = """
WITH per AS (SELECT o_custkey AS entity,
               date_diff('day', MAX(CAST(o_orderdate AS DATE)), (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderdate IS NOT NULL)) AS recency_days,
               COUNT(*) AS frequency, ROUND(SUM(o_totalprice), 2) AS monetary
             FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
scored AS (SELECT entity, recency_days, frequency, monetary,
             CAST(NTILE(5) OVER (ORDER BY recency_days DESC NULLS LAST, entity ASC NULLS LAST) AS BIGINT) AS r_score,
             CAST(NTILE(5) OVER (ORDER BY frequency ASC NULLS LAST, entity ASC NULLS LAST) AS BIGINT) AS f_score,
             CAST(NTILE(5) OVER (ORDER BY monetary ASC NULLS LAST, entity ASC NULLS LAST) AS BIGINT) AS m_score
           FROM per)
"""


@register("T18_rfm_scored", _RFM + "SELECT * FROM scored")
def t18(spark, sf):
    return rfm(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice").scored


@register(
    "T18_rfm_segments",
    _RFM
    + """
SELECT r_score || '-' || f_score || '-' || m_score AS rfm_score, COUNT(*) AS entities FROM scored
GROUP BY 1 ORDER BY entities DESC, rfm_score ASC
""",
)
def t18s(spark, sf):
    return rfm(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice").segments


@register(
    "T18_rfm_metrics",
    _RFM
    + """
SELECT COUNT(*) AS entities, COUNT(*) FILTER (WHERE r_score >= 4 AND f_score >= 4 AND m_score >= 4) AS champions,
       ROUND(COUNT(*) FILTER (WHERE r_score >= 4 AND f_score >= 4 AND m_score >= 4) * 100.0 / COUNT(*), 1) AS champions_pct
FROM scored
""",
)
def t18m(spark, sf):
    return rfm(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice").metrics
