"""Registered queries: one-column statistics."""

from __future__ import annotations

from ..operators.describe import describe, fit_distribution, outliers
from .catalog import flat_arrays, register, round6, table
from .sqlfrag import chi2_cdf_sql


@register(
    "T1_describe",
    """
SELECT count(x) AS count, ROUND(avg(x), 6) AS mean, ROUND(stddev_samp(x), 6) AS stddev,
       min(x) AS min, ROUND(quantile_cont(x, 0.25), 6) AS p25, ROUND(median(x), 6) AS median,
       ROUND(quantile_cont(x, 0.75), 6) AS p75, max(x) AS max,
       CASE WHEN count(*) = 0 THEN 0.0 ELSE ROUND((count(*) - count(x)) / count(*), 4) END AS null_fraction,
       CASE WHEN count(x) = 0 THEN 'every value of the column is missing' ELSE '' END AS caveats
FROM (SELECT CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem)
""",
)
def t1(spark, sf):
    d = describe(table(spark, sf, "lineitem"), "l_extendedprice")
    return flat_arrays(round6(d, {"mean", "stddev", "p25", "median", "p75"}))


_IQR_BOUNDS = """
WITH b AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem),
lim AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b)
"""


# text lengths have a long upper tail, so there are outliers to return
_LENGTHS = ["doc_id", "lang", "source", "n_chars"]


@register(
    "T2_outliers_iqr_rows",
    """
WITH b AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents),
lim AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b)
SELECT doc_id, lang, source, n_chars FROM documents, lim WHERE n_chars < lo OR n_chars > hi
""",
)
def t2_rows(spark, sf):
    return outliers(table(spark, sf, "documents").select(*_LENGTHS), "n_chars", "iqr", 1.5).rows


@register(
    "T2_outliers_iqr_metrics",
    _IQR_BOUNDS
    + """
SELECT 'iqr' AS method, ROUND(lo, 4) AS lower_bound, ROUND(hi, 4) AS upper_bound,
       count(*) FILTER (WHERE l_extendedprice < lo OR l_extendedprice > hi) AS outlier_count,
       CASE WHEN count(l_extendedprice) = 0 THEN 0.0 ELSE
         ROUND(count(*) FILTER (WHERE l_extendedprice < lo OR l_extendedprice > hi) / count(l_extendedprice), 4) END
         AS outlier_fraction
FROM lineitem, lim GROUP BY lo, hi
""",
)
def t2_metrics(spark, sf):
    return outliers(table(spark, sf, "lineitem"), "l_extendedprice", "iqr", 1.5).metrics


_Z_BOUNDS = """
WITH b AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders),
lim AS (SELECT m - 2.0 * s AS lo, m + 2.0 * s AS hi FROM b)
"""


@register(
    "T2_outliers_zscore_rows",
    """
WITH lim AS (SELECT avg(n_chars) - 2.0 * stddev_samp(n_chars) AS lo, avg(n_chars) + 2.0 * stddev_samp(n_chars) AS hi
             FROM documents)
SELECT doc_id, lang, source, n_chars FROM documents, lim WHERE n_chars < lo OR n_chars > hi
""",
)
def t2z_rows(spark, sf):
    return outliers(table(spark, sf, "documents").select(*_LENGTHS), "n_chars", "zscore", 2.0).rows


@register(
    "T2_outliers_zscore_metrics",
    _Z_BOUNDS
    + """
SELECT 'zscore' AS method, ROUND(lo, 4) AS lower_bound, ROUND(hi, 4) AS upper_bound,
       count(*) FILTER (WHERE o_totalprice < lo OR o_totalprice > hi) AS outlier_count,
       CASE WHEN count(o_totalprice) = 0 THEN 0.0 ELSE
         ROUND(count(*) FILTER (WHERE o_totalprice < lo OR o_totalprice > hi) / count(o_totalprice), 4) END
         AS outlier_fraction
FROM orders, lim GROUP BY lo, hi
""",
)
def t2z_metrics(spark, sf):
    return outliers(table(spark, sf, "orders"), "o_totalprice", "zscore", 2.0).metrics


@register(
    "T5_fit_gaussian",
    """
WITH x AS (SELECT CAST(c_acctbal AS DOUBLE) AS v FROM customer WHERE c_acctbal IS NOT NULL),
s AS (SELECT count(*) AS cnt, CAST(count(*) AS DOUBLE) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM x),
mo AS (SELECT s.cnt, s.n, s.mean, s.sd, avg(power(v - s.mean, 2)) AS m2, avg(power(v - s.mean, 3)) AS m3,
              avg(power(v - s.mean, 4)) AS m4 FROM x, s GROUP BY ALL),
a AS (SELECT *, m3 / power(m2, 1.5) AS g1, m4 / (m2 * m2) AS b2,
        3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
        3.0 * (n - 1) / (n + 1) AS e,
        24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) AS v,
        6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb1
      FROM mo),
b AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y0, sqrt(2 * (beta2 - 1)) - 1 AS w2,
        (b2 - e) / sqrt(v) AS xk, 6 + (8 / sb1) * (2 / sb1 + sqrt(1 + 4 / (sb1 * sb1))) AS aa FROM a),
c AS (SELECT *, CASE WHEN y0 = 0 THEN 1 ELSE y0 END AS y, 1 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2 / (w2 - 1)) AS alpha,
        (1 - 2.0 / aa) / (1 + xk * sqrt(2 / (aa - 4))) AS inner_ FROM b),
d AS (SELECT *, delta * ln(y / alpha + sqrt((y / alpha) * (y / alpha) + 1)) AS z1,
        ((1 - 2 / (9 * aa)) - sign(inner_) * power(abs(inner_), 1.0 / 3)) / sqrt(2 / (9 * aa)) AS z2 FROM c),
k AS (SELECT *, z1 * z1 + z2 * z2 AS k2 FROM d)
SELECT 'gaussian' AS family, cnt AS n, ROUND(mean, 4) AS mu, ROUND(sd, 4) AS sigma, ROUND(k2, 4) AS statistic,
       ROUND(exp(-k2 / 2), 6) AS p_value, exp(-k2 / 2) >= 0.05 AS is_normal,
       CASE WHEN cnt < 20 THEN 'fewer than 20 values: the test can hardly tell a normal law from others' ELSE '' END AS caveats
FROM k
""",
)
def t5_gaussian(spark, sf):
    return flat_arrays(fit_distribution(table(spark, sf, "customer"), "c_acctbal", "gaussian"))


@register(
    "T5_fit_poisson",
    """
WITH x AS (SELECT CAST(l_quantity AS DOUBLE) AS v FROM lineitem WHERE l_quantity IS NOT NULL),
s AS (SELECT count(*) AS cnt, CAST(count(*) AS DOUBLE) AS n, avg(v) AS lam, var_samp(v) AS var,
             max(abs(v - round(v)) - (1e-8 + 1e-5 * abs(round(v)))) AS nonint FROM x),
t AS (SELECT *, var / lam AS disp, (n - 1) * var / lam AS stat FROM s),
p AS (SELECT *, """
    + chi2_cdf_sql("stat", "(n - 1)")
    + """ AS cdf FROM t)
SELECT 'poisson' AS family, cnt AS n, ROUND(lam, 4) AS lambda, ROUND(var, 4) AS variance,
       ROUND(disp, 4) AS dispersion_index, ROUND(least(1.0, 2 * least(cdf, 1 - cdf)), 6) AS p_value,
       least(1.0, 2 * least(cdf, 1 - cdf)) >= 0.05 AS consistent_with_poisson,
       concat_ws('; ', CASE WHEN nonint > 0 THEN 'some values are no whole numbers, as counts would be' END,
                       CASE WHEN disp > 1.5 THEN 'the variance exceeds the mean by far; a negative binomial law may fit better' END)
         AS caveats
FROM p
""",
)
def t5_poisson(spark, sf):
    return flat_arrays(fit_distribution(table(spark, sf, "lineitem"), "l_quantity", "poisson"))
