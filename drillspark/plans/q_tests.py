"""Registered queries: tests, correlations and fits."""

from __future__ import annotations

from ..operators.models import linear_fit, logistic_fit
from ..operators.stat_tests import chi_square, correlation, correlation_matrix, mann_whitney, t_test
from .catalog import flat_arrays, register, table
from .sqlfrag import chi2_sf_even_sql, normal_two_sided_sql, t_two_sided_sql


def _welch_sql(groups_cte: str) -> str:
    return (
        groups_cte
        + """
, x AS (SELECT CAST(o_totalprice AS DOUBLE) AS v, CAST(o_orderstatus AS VARCHAR) AS g FROM orders
        WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL),
s AS (SELECT pair.ga, pair.gb,
        count(*) FILTER (WHERE g = pair.ga) AS na, count(*) FILTER (WHERE g = pair.gb) AS nb,
        avg(v) FILTER (WHERE g = pair.ga) AS ma, avg(v) FILTER (WHERE g = pair.gb) AS mb,
        var_samp(v) FILTER (WHERE g = pair.ga) AS va, var_samp(v) FILTER (WHERE g = pair.gb) AS vb
      FROM x, pair GROUP BY pair.ga, pair.gb),
t AS (SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS tt,
        power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1)) AS dof FROM s),
p AS (SELECT *, """
        + t_two_sided_sql("tt", "dof")
        + """ AS p FROM t)
SELECT ga AS group_a, gb AS group_b, ROUND(ma, 4) AS mean_a, ROUND(mb, 4) AS mean_b, ROUND(ma - mb, 4) AS diff,
       ROUND(tt, 4) AS t_stat, ROUND(p, 6) AS p_value, na AS n_a, nb AS n_b, p < 0.05 AS significant
FROM p
"""
    )


_GIVEN = "WITH pair AS (SELECT 'F' AS ga, 'O' AS gb)"
_TOP2 = """
WITH c AS (SELECT CAST(o_orderstatus AS VARCHAR) AS g, count(*) AS c FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1),
r AS (SELECT g, row_number() OVER (ORDER BY c DESC, g ASC) AS rk FROM c),
pair AS (SELECT max(g) FILTER (WHERE rk = 1) AS ga, max(g) FILTER (WHERE rk = 2) AS gb FROM r)
"""


@register("T6_t_test", _welch_sql(_GIVEN))
def t6(spark, sf):
    return t_test(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus", "F", "O")


@register("T6_t_test_top2", _welch_sql(_TOP2))
def t6_auto(spark, sf):
    return t_test(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus")


def _mwu_sql(groups_cte: str) -> str:
    return (
        groups_cte
        + """
, x AS (SELECT CAST(o_totalprice AS DOUBLE) AS v, CAST(o_orderstatus AS VARCHAR) AS g FROM orders, pair
        WHERE o_totalprice IS NOT NULL AND CAST(o_orderstatus AS VARCHAR) IN (pair.ga, pair.gb)),
vc AS (SELECT v, count(*) AS cnt, count(*) FILTER (WHERE g = (SELECT ga FROM pair)) AS ca,
              count(*) FILTER (WHERE g = (SELECT gb FROM pair)) AS cb FROM x GROUP BY v),
cum AS (SELECT *, sum(cb) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) - cb AS below_b FROM vc),
s AS (SELECT CAST(sum(ca) AS DOUBLE) AS na, CAST(sum(cb) AS DOUBLE) AS nb, sum(ca * (below_b + cb / 2.0)) AS u,
             CAST(sum(cnt * cnt * cnt - cnt) AS DOUBLE) AS tie FROM cum),
z AS (SELECT *, (greatest(u, na * nb - u) - na * nb / 2.0 - 0.5)
               / sqrt(na * nb / 12.0 * ((na + nb + 1) - tie / ((na + nb) * (na + nb - 1)))) AS z FROM s),
p AS (SELECT *, CASE WHEN z < 0 THEN 1.0 ELSE """
        + normal_two_sided_sql("z")
        + """ END AS p FROM z)
SELECT pair.ga AS group_a, pair.gb AS group_b,
       ROUND((SELECT median(v) FROM x WHERE g = pair.ga), 4) AS median_a,
       ROUND((SELECT median(v) FROM x WHERE g = pair.gb), 4) AS median_b,
       ROUND(u, 2) AS u_stat, ROUND(p, 6) AS p_value, CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b,
       p < 0.05 AS significant
FROM p, pair
"""
    )


@register("T7_mann_whitney", _mwu_sql(_GIVEN))
def t7(spark, sf):
    return mann_whitney(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus", "F", "O")


@register("T7_mann_whitney_top2", _mwu_sql(_TOP2))
def t7_auto(spark, sf):
    return mann_whitney(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus")


def _chi_sql(src: str, a: str, b: str, p_expr: str) -> str:
    return f"""
WITH o AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS o FROM {src}
           WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
ra AS (SELECT a, sum(o) AS r FROM o GROUP BY a), cb AS (SELECT b, sum(o) AS c FROM o GROUP BY b),
n AS (SELECT (SELECT sum(o) FROM o) AS n, (SELECT count(*) FROM ra) AS nr, (SELECT count(*) FROM cb) AS nc),
cells AS (SELECT ra.r * cb.c / n.n AS e, coalesce(o.o, 0) AS o, n.n, n.nr, n.nc
          FROM ra CROSS JOIN cb CROSS JOIN n LEFT JOIN o ON o.a = ra.a AND o.b = cb.b),
s AS (SELECT sum(CASE WHEN (nr - 1) * (nc - 1) = 1 THEN power(abs(o - e) - least(0.5, abs(o - e)), 2) / e
                      ELSE power(o - e, 2) / e END) AS chi2,
             avg(CASE WHEN e < 5 THEN 1.0 ELSE 0.0 END) AS small, any_value(n) AS n, any_value(nr) AS nr,
             any_value(nc) AS nc FROM cells),
p AS (SELECT *, {p_expr} AS p FROM s)
SELECT ROUND(chi2, 4) AS chi2, ROUND(p, 6) AS p_value, CAST((nr - 1) * (nc - 1) AS BIGINT) AS dof,
       ROUND(sqrt(chi2 / (n * (least(nr, nc) - 1))), 4) AS cramers_v, p < 0.05 AS significant,
       CASE WHEN small > 0.2 THEN 'more than a fifth of the cells expect under 5 rows, too few for the approximation' ELSE '' END
         AS caveats
FROM p
"""


@register("T8_chi_square", _chi_sql("orders", "o_orderstatus", "o_orderpriority", chi2_sf_even_sql("chi2", 8)))
def t8(spark, sf):
    return flat_arrays(chi_square(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))


@register("T8_chi_square_yates", _chi_sql("labels", "quality", "toxic", normal_two_sided_sql("sqrt(chi2)")))
def t8_yates(spark, sf):
    return flat_arrays(chi_square(table(spark, sf, "labels"), "quality", "toxic"))


def _corr_sql(rx: str, ry: str, method: str) -> str:
    return f"""
WITH x AS (SELECT CAST(l_extendedprice AS DOUBLE) AS x, CAST(l_quantity AS DOUBLE) AS y FROM lineitem
           WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL),
rk AS (SELECT {rx} AS x, {ry} AS y FROM x),
s AS (SELECT count(*) AS n, corr(x, y) AS r FROM rk),
t AS (SELECT *, r * sqrt((n - 2) / ((1 - r) * (1 + r))) AS tt FROM s),
p AS (SELECT *, CASE WHEN abs(r) >= 1 THEN 0.0 ELSE {t_two_sided_sql("tt", "(n - 2)")} END AS p FROM t)
SELECT '{method}' AS method, ROUND(r, 4) AS r, ROUND(p, 6) AS p_value, n, p < 0.05 AS significant,
       CASE WHEN abs(r) < 0.1 THEN 'negligible' WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.5 THEN 'moderate'
            ELSE 'strong' END AS strength,
       CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction
FROM p
"""


@register("T9_correlation_pearson", _corr_sql("x", "y", "pearson"))
def t9p(spark, sf):
    return correlation(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", "pearson")


_AVG_RANK = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@register(
    "T9_correlation_spearman",
    _corr_sql(_AVG_RANK.format(c="x"), _AVG_RANK.format(c="y"), "spearman"),
)
def t9s(spark, sf):
    return correlation(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", "spearman")


_MATRIX_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _matrix_sql() -> str:
    cols = _MATRIX_COLS
    where = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    parts = []
    for a in cols:
        for b in cols:
            if a == b:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, 1.0 AS r")
            else:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, ROUND(corr({a}, {b}), 3) AS r FROM lineitem WHERE {where}")
    return "\nUNION ALL\n".join(parts)


@register("T10_correlation_matrix", _matrix_sql())
def t10(spark, sf):
    return correlation_matrix(table(spark, sf, "lineitem"), _MATRIX_COLS).long


def _matrix_metrics_sql() -> str:
    cols = _MATRIX_COLS
    where = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i < j:
                parts.append(f"SELECT '{a}' AS a, '{b}' AS b, {i} AS i, {j} AS j, corr({a}, {b}) AS r FROM lineitem WHERE {where}")
    union = " UNION ALL ".join(parts)
    return f"""
WITH c AS ({union}),
best AS (SELECT arg_min(a || '~' || b, (-abs(r), i, j)) AS pair, arg_min(r, (-abs(r), i, j)) AS r FROM c
         WHERE r IS NOT NULL AND abs(r) > 0)
SELECT {len(cols)} AS columns, ROUND(coalesce(r, 0.0), 3) AS strongest_r, pair AS strongest_pair FROM best
"""


@register("T10_correlation_matrix_metrics", _matrix_metrics_sql())
def t10m(spark, sf):
    return correlation_matrix(table(spark, sf, "lineitem"), _MATRIX_COLS).metrics


_OLS = """
WITH d AS (SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS x1, CAST(l_discount AS DOUBLE) AS x2
           FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL AND l_discount IS NOT NULL),
m AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM d),
s AS (SELECT any_value(n) AS n, any_value(my) AS my, any_value(m1) AS m1, any_value(m2) AS m2,
             sum((x1 - m1) * (x1 - m1)) AS s11, sum((x1 - m1) * (x2 - m2)) AS s12, sum((x2 - m2) * (x2 - m2)) AS s22,
             sum((x1 - m1) * (y - my)) AS s1y, sum((x2 - m2) * (y - my)) AS s2y, sum((y - my) * (y - my)) AS syy
      FROM d, m),
b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
                (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s),
f AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0,
             CASE WHEN syy = 0 THEN 0.0 ELSE 1 - (syy - 2 * (b1 * s1y + b2 * s2y)
                  + (b1 * b1 * s11 + 2 * b1 * b2 * s12 + b2 * b2 * s22)) / syy END AS r2 FROM b)
"""


@register(
    "T14_linear_fit_coefficients",
    _OLS
    + """
SELECT 0 AS term_index, 'intercept' AS term, ROUND(b0, 4) AS coefficient FROM f
UNION ALL SELECT 1, 'l_quantity', ROUND(b1, 4) FROM f
UNION ALL SELECT 2, 'l_discount', ROUND(b2, 4) FROM f
""",
)
def t14(spark, sf):
    return linear_fit(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]).coefficients


@register(
    "T14_linear_fit_metrics",
    _OLS
    + """
SELECT ROUND(r2, 4) AS r_squared, n,
       CASE WHEN abs(ROUND(b2, 4)) > abs(ROUND(b1, 4)) THEN 'l_discount' ELSE 'l_quantity' END AS top_predictor FROM f
""",
)
def t14m(spark, sf):
    return linear_fit(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]).metrics


def _labelled_docs(spark, sf):
    lab = table(spark, sf, "labels")
    docs = table(spark, sf, "documents")
    return lab.join(docs, "doc_id").select("doc_id", "quality", "n_chars")


# Newton's steps for one standardised predictor, as a recursive query
_IRLS = """
WITH RECURSIVE raw AS (
  SELECT CAST(quality AS VARCHAR) AS c, CAST(n_chars AS DOUBLE) AS v FROM labels JOIN documents USING (doc_id)
  WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
shape AS (SELECT max(c) AS pos, avg(v) AS mu, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS sd, count(*) AS n FROM raw),
d AS MATERIALIZED (SELECT CASE WHEN c = pos THEN 1.0 ELSE 0.0 END AS y, (v - mu) / sd AS x FROM raw, shape),
steps(k, b0, b1, size) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT k + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01),
    greatest(abs((h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01)), abs((h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)))
  FROM steps, LATERAL (
    SELECT sum(w) AS h00, sum(w * x) AS h01, sum(w * x * x) AS h11, sum(y - p) AS g0, sum(x * (y - p)) AS g1
    FROM (SELECT x, y, p, greatest(p * (1 - p), 1e-6) AS w
          FROM (SELECT x, y, 1 / (1 + exp(-least(30, greatest(-30, steps.b0 + steps.b1 * x)))) AS p FROM d)))
  WHERE size >= 1e-6 AND k < 50),
beta AS (SELECT b0, b1 FROM steps ORDER BY k DESC LIMIT 1)
"""


@register(
    "T15_logistic_fit_coefficients",
    _IRLS
    + """
SELECT 0 AS term_index, 'intercept' AS term, ROUND(b0 - b1 * mu / sd, 4) AS coefficient FROM beta, shape
UNION ALL SELECT 1, 'n_chars', ROUND(b1 / sd, 4) FROM beta, shape
""",
)
def t15(spark, sf):
    return logistic_fit(_labelled_docs(spark, sf), "quality", ["n_chars"]).coefficients


@register(
    "T15_logistic_fit_metrics",
    _IRLS
    + """,
fitted AS (SELECT y, 1 / (1 + exp(-least(30, greatest(-30, b0 + b1 * x)))) AS p FROM d, beta),
s AS (SELECT sum(y * ln(p + 1e-9) + (1 - y) * ln(1 - p + 1e-9)) AS ll, avg(y) AS base, count(*) AS n,
             avg(CASE WHEN (p > 0.5) = (y > 0.5) THEN 1.0 ELSE 0.0 END) AS acc FROM fitted)
SELECT ROUND(1 - ll / (s.n * (base * ln(base + 1e-9) + (1 - base) * ln(1 - base + 1e-9))), 4) AS pseudo_r2_mcfadden,
       ROUND(acc, 4) AS accuracy, s.n AS n, pos AS positive_class, '' AS caveats
FROM s, shape
""",
)
def t15m(spark, sf):
    return flat_arrays(logistic_fit(_labelled_docs(spark, sf), "quality", ["n_chars"]).metrics)
