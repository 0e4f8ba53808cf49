"""Distributed ranks, fits (T14, T15) and entity analytics."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from drillspark.functions.ranks import average_ranks, exact_quantiles, ntile_of, partition_row_numbers, row_numbers
from drillspark.functions.columns import OperatorError
from drillspark.operators.customers import cohort_retention, funnel, rfm
from drillspark.operators.models import linear_fit, logistic_fit
from pyspark.sql import functions as F


def test_exact_quantiles_grouped_with_skew_and_ties(spark):
    rng = np.random.default_rng(3)
    hot = [("hot", float(v)) for v in rng.integers(0, 50, 3000)]  # one group holds most rows, many ties
    cold = [(f"g{i % 7}", float(v)) for i, v in enumerate(rng.normal(0, 1, 700))]
    df = spark.createDataFrame(hot + cold + [("empty", None), (None, 1.0), (None, 3.0)], "k string, v double")
    got = {r["k"]: r for r in exact_quantiles(df, "v", [0.1, 0.5, 0.9], by=["k"]).collect()}
    pdf = df.toPandas()
    for key, grp in pdf.groupby("k", dropna=False):
        vals = grp["v"].dropna().to_numpy()
        r = got[None if (isinstance(key, float) and np.isnan(key)) else key]
        if len(vals) == 0:
            assert r["n"] == 0 and r["q1"] is None
            continue
        for i, q in enumerate((0.1, 0.5, 0.9)):
            assert r[f"q{i}"] == pytest.approx(np.quantile(vals, q))


def test_average_ranks_and_row_numbers(spark):
    vals = [3.0, 1.0, 3.0, 2.0, 3.0, 5.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v double")
    ranks = {r["v"]: r["rank"] for r in average_ranks(df, "v").collect()}
    expected = pd.Series(vals).rank()
    for v, rk in zip(vals, expected):
        assert ranks[v] == rk
    rn = row_numbers(df, [F.col("v").desc(), F.col("id").asc()], "rn").orderBy("rn").collect()
    assert [r["id"] for r in rn] == [5, 0, 2, 4, 3, 1]
    nt = rn_df = row_numbers(df, [F.col("id").asc()], "rn").withColumn("nt", ntile_of(F.col("rn"), F.lit(6), 4))
    assert [r["nt"] for r in nt.orderBy("rn").collect()] == [1, 1, 2, 2, 3, 4]
    assert rn_df.count() == 6


def test_partition_row_numbers_hot_key(spark):
    data = [("hot", i) for i in range(500)] + [("a", 2), ("a", 1), (None, 5)]
    df = spark.createDataFrame(data, "k string, x long")
    out = partition_row_numbers(df, ["k"], [F.col("x").asc()], "rn")
    got = {(r["k"], r["x"]): (r["rn"], r["rn_count"]) for r in out.collect()}
    assert got[("hot", 0)] == (1, 500) and got[("hot", 499)] == (500, 500)
    assert got[("a", 1)] == (1, 2) and got[("a", 2)] == (2, 2) and got[(None, 5)] == (1, 1)


def test_linear_fit_matches_lstsq(spark):
    rng = np.random.default_rng(11)
    x1, x2 = rng.normal(size=200), rng.normal(size=200)
    y = 3 + 2 * x1 - 0.5 * x2 + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(y, x1, x2)] + [(None, 1.0, 1.0)], "y double, x1 double, x2 double")
    fit = linear_fit(df, "y", ["x1", "x2"])
    coefs = {r["term"]: r["coefficient"] for r in fit.coefficients.collect()}
    beta, *_ = np.linalg.lstsq(np.column_stack([np.ones(200), x1, x2]), y, rcond=None)
    assert coefs["intercept"] == pytest.approx(round(beta[0], 4))
    assert coefs["x1"] == pytest.approx(round(beta[1], 4)) and coefs["x2"] == pytest.approx(round(beta[2], 4))
    m = fit.metrics.first()
    assert m["n"] == 200 and m["top_predictor"] == "x1" and m["r_squared"] > 0.99


def _irls(X, y, iters=50):
    mu, sd = X.mean(0), X.std(0)
    sd = np.where(sd == 0, 1.0, sd)
    Xs = np.column_stack([np.ones(len(X)), (X - mu) / sd])
    beta = np.zeros(Xs.shape[1])
    for _ in range(iters):
        p = 1 / (1 + np.exp(-np.clip(Xs @ beta, -30, 30)))
        w = np.clip(p * (1 - p), 1e-6, None)
        step = np.linalg.solve(Xs.T @ (w[:, None] * Xs), Xs.T @ (y - p))
        beta = beta + step
        if np.max(np.abs(step)) < 1e-6:
            break
    p = 1 / (1 + np.exp(-np.clip(Xs @ beta, -30, 30)))
    return beta[0] - np.sum(beta[1:] * mu / sd), beta[1:] / sd, np.mean((p > 0.5) == (y > 0.5))


def test_logistic_fit_matches_irls_and_survives_separation(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    y = (rng.uniform(size=300) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, x)], "y int, x double")
    fit = logistic_fit(df, "y", ["x"])
    b0, b1, acc = _irls(x[:, None], y.astype(float))
    coefs = {r["term"]: r["coefficient"] for r in fit.coefficients.collect()}
    assert coefs["intercept"] == pytest.approx(round(b0, 4), abs=2e-4)
    assert coefs["x"] == pytest.approx(round(float(b1[0]), 4), abs=2e-4)
    assert fit.metrics.first()["accuracy"] == pytest.approx(round(acc, 4))
    # separable: y = x > 50 on 1..100 (the reference's own test case)
    sep = spark.createDataFrame([(int(i > 50), i) for i in range(1, 101)], "y int, x int")
    m = logistic_fit(sep, "y", ["x"]).metrics.first()
    assert m["accuracy"] > 0.8 and m["positive_class"] == "1"
    three = spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "y int, x double")
    with pytest.raises(OperatorError, match="binary"):
        logistic_fit(three, "y", ["x"])


def test_funnel_reference_case(spark):
    rows = [(f"u{i}", "view") for i in range(10)] + [(f"u{i}", "cart") for i in range(6)]
    rows += [(f"u{i}", "purchase") for i in range(3)] + [("u0", "view")]
    df = spark.createDataFrame(rows, "user_id string, stage string")
    res = funnel(df, "user_id", "stage", ["view", "cart", "purchase", "refund"])
    t = [(r["step"], r["entities"], r["pct_of_prev"], r["pct_of_start"]) for r in res.table.collect()]
    assert t == [("view", 10, None, 100.0), ("cart", 6, 60.0, 60.0), ("purchase", 3, 50.0, 30.0), ("refund", 0, 0.0, 0.0)]
    m = res.metrics.first()
    assert (m["start_entities"], m["end_entities"], m["overall_conversion_pct"]) == (10, 0, 0.0)
    with pytest.raises(OperatorError):
        funnel(df, "user_id", "stage", ["view"])


def test_cohort_retention(spark):
    d = dt.date
    rows = [("a", d(2024, 1, 5)), ("a", d(2024, 2, 1)), ("b", d(2024, 1, 9)), ("c", d(2024, 2, 3)),
            ("c", d(2024, 3, 3)), ("a", d(2024, 3, 9)), ("d", None), (None, d(2024, 1, 1))]
    df = spark.createDataFrame(rows, "who string, day date")
    res = cohort_retention(df, "who", "day", "month")
    t = [(str(r["cohort"]), r["period_offset"], r["active"], r["retention_pct"]) for r in res.table.collect()]
    assert t == [("2024-01-01", 0, 2, 100.0), ("2024-01-01", 1, 1, 50.0), ("2024-01-01", 2, 1, 50.0),
                 ("2024-02-01", 0, 1, 100.0), ("2024-02-01", 1, 1, 100.0)]
    m = res.metrics.first()
    assert m["cohorts"] == 2 and m["avg_next_period_retention_pct"] == 75.0


def test_rfm_scores_match_pandas_ntile(spark):
    rng = np.random.default_rng(9)
    n = 400
    days = rng.integers(0, 60, n)
    rows = [(f"c{int(c)}", dt.date(2024, 1, 1) + dt.timedelta(days=int(dd)), float(v))
            for c, dd, v in zip(rng.integers(0, 37, n), days, np.round(rng.uniform(1, 100, n), 2))]
    df = spark.createDataFrame(rows, "cust string, day date, amount double")
    res = rfm(df, "cust", "day", "amount")
    got = res.scored.toPandas().set_index("entity")
    pdf = pd.DataFrame(rows, columns=["cust", "day", "amount"])
    last = pdf.day.max()
    per = pdf.groupby("cust").agg(mx=("day", "max"), frequency=("day", "size"), monetary=("amount", "sum"))
    per["recency_days"] = (last - per.mx).map(lambda x: x.days)

    def ntile(order_frame):
        k = len(order_frame)
        q, r = divmod(k, 5)
        out = []
        for i in range(k):
            out.append(i // (q + 1) + 1 if i < r * (q + 1) else r + (i - r * (q + 1)) // q + 1)
        return pd.Series(out, index=order_frame.index)

    per = per.reset_index()
    r_s = ntile(per.sort_values(["recency_days", "cust"], ascending=[False, True]))
    f_s = ntile(per.sort_values(["frequency", "cust"]))
    for i, row in per.iterrows():
        assert got.loc[row.cust, "r_score"] == r_s[i]
        assert got.loc[row.cust, "f_score"] == f_s[i]
        assert got.loc[row.cust, "recency_days"] == row.recency_days
    m = res.metrics.first()
    assert m["entities"] == 37
