"""Whitening against a dense eigen-decomposition of the fit list."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_ORACLE, SF_SMALL
from drillspark.llm import whitening as W
from drillspark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def brute_force(frame: pd.DataFrame, components: int = 4):
    """{vec_id: deviation}, {vec_id: |whitened|}, shares, from a dense eigh."""
    kept = {}
    for i, v in zip(frame["vec_id"], frame["embedding"]):
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            kept[i] = [math.floor(256 * float(c)) for c in v]
    x = np.array(sorted(set(map(tuple, kept.values()))), float)
    n, mean = len(x), x.mean(axis=0)
    value, vector = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    order = np.argsort(value)[::-1][:components]
    sums = [sum(int(r[k]) for r in x) for k in range(x.shape[1])]
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for i, v in kept.items()}
    made = {i: np.abs((np.array(v) - mean) @ vector[:, order] / np.sqrt(value[order])) for i, v in kept.items()}
    return n, deviation, made, value[order] / value.sum()


@pytest.mark.parametrize("sf", [SF_SMALL, SF_ORACLE])
def test_query_matches_a_dense_eigen_decomposition(spark, sf):
    got = QUERIES["op12_bidiagonal_whitening"](spark, sf).toPandas()
    n, deviation, made, shares = brute_force(pd.read_parquet(f"{sf}/embeddings.parquet"))
    assert dict(got.dtypes.astype(str)) == {
        "vec_id": "int64", "component": "int32", "n": "int64", "deviation": "int64",
        "whitened": "float64", "explained": "float64", "identity_error": "float64",
    }
    assert set(got["n"]) == {n} and len(got) == 4 * len(deviation)
    assert {(i, d) for i, d in zip(got["vec_id"], got["deviation"])} == set(deviation.items())
    wide = got.pivot(index="vec_id", columns="component", values="whitened")
    for i, row in wide.iterrows():
        np.testing.assert_allclose(np.abs(row.to_numpy()), made[i], atol=1e-9)
    by = got.groupby("component")["explained"].agg(["min", "max"])
    np.testing.assert_allclose(by["min"], shares, rtol=1e-10)
    assert (by["min"] == by["max"]).all()
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10
    # one sign for all rows: components of distinct vectors are uncorrelated with unit variance
    cov = np.cov(wide.to_numpy().T, bias=True)
    assert np.abs(cov - np.eye(4)).max() < 0.2  # copies weigh here, so only roughly


def test_null_non_finite_and_repeated_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 6)).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(base)]
    rows += [(100 + i, rows[0][1], 0) for i in range(300)]  # one vector, over nine tenths of the rows
    rows += [(None, rows[1][1], None)]
    rows += [(200_001, None, 1), (200_002, [None, *rows[0][1][1:]], 1), (200_003, [float("nan"), *rows[0][1][1:]], 1)]
    rows += [(200_004, [float("inf"), *rows[0][1][1:]], 1), (200_005, rows[0][1][:3], 1), (200_006, [], 1)]
    rows += [(200_007, [3e38, *rows[0][1][1:]], 1)]
    out = W.whitened_components(vectors(spark, rows), "vec_id").toPandas()
    assert len(out) == 4 * 331 and not (out["vec_id"] > 200_000).any()
    plain = W.whitened_components(vectors(spark, rows[:30]), "vec_id").toPandas()
    assert set(out["n"]) == set(plain["n"]) == {30}
    a = out[out["vec_id"] < 30].sort_values(["vec_id", "component"])["whitened"].to_numpy()
    b = plain.sort_values(["vec_id", "component"])["whitened"].to_numpy()
    np.testing.assert_allclose(np.abs(a), np.abs(b), atol=1e-9)
    alike = out[(out["vec_id"] >= 100) | (out["vec_id"] == 0)].groupby("component")["whitened"].nunique()
    assert (alike == 1).all()


def test_exact_deviation_beyond_doubles(spark):
    rows = [(i, [1e9 * i, -7.25, 3.0 + i], 0) for i in range(3)] + [(9, [4e15, 0.5, 0.5], 0)]
    out = W.whitened_components(vectors(spark, rows, "vec_id long, embedding array<double>, label int"), "vec_id")
    got = {r.vec_id: r.deviation for r in out.collect()}
    x = [[math.floor(Fraction(c) * 256) for c in v] for _, v, _ in rows]
    sums = [sum(c) for c in zip(*x)]
    want = {r[0]: sum((len(x) * a - s) ** 2 for a, s in zip(v, sums)) for r, v in zip(rows, x)}
    assert got == {i: v if v < 2**63 else None for i, v in want.items()}


def test_empty_tables_single_vectors_and_flat_directions(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None, 0)], [(1, [], 0)], [(1, [0.5, 0.25], 0)], [(1, [0.5], 0), (2, [0.5], 0)]):
        out = W.whitened_components(vectors(spark, rows), "vec_id")
        assert out.columns == columns and out.count() == 0
    line = W.whitened_components(vectors(spark, [(i, [float(i), float(i), 1.0], 0) for i in range(5)]), "vec_id").toPandas()
    assert set(line["component"]) == {1} and line["explained"][0] == pytest.approx(1.0)


def test_clashing_columns_are_replaced_and_others_kept(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in v], 1, 2, 3) for i, v in enumerate(rng.normal(size=(12, 5)))]
    df = vectors(spark, rows, "vec_id long, embedding array<float>, x int, whitened int, row int")
    out = W.whiten(df, W.fit(df))
    assert out.columns == ["vec_id", "embedding", "x", "row", "deviation", "whitened"]
    got = out.collect()
    assert len(got) == 12 and {(r.x, r.row) for r in got} == {(1, 3)} and len(got[0].whitened) == 4


def test_merging_triangles_in_a_tree(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(rng.normal(size=(400, 5)))]
    df = vectors(spark, rows).repartition(13)
    x = df.select(W.quantised(F.col("embedding")).alias("x"))
    dense = np.array([r.x for r in x.collect()], float)
    mean = dense.mean(axis=0)
    monkeypatch.setattr(W, "MERGE_BYTES", 1)  # two triangles a task: four levels
    r = W._reduce(x, mean)
    np.testing.assert_allclose(r.T @ r, (dense - mean).T @ (dense - mean), rtol=1e-12, atol=1e-6)


@given(st.integers(1, 12), st.integers(0, 10**6), st.sampled_from(["plain", "graded", "equal", "low"]))
@settings(max_examples=80, deadline=None)
def test_solver_against_a_library_svd(d, seed, kind):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(d, d))
    if kind == "graded":
        m *= np.logspace(0, -25, d)
    if kind == "equal":
        m = np.linalg.qr(m)[0] * 3
    if kind == "low":
        m[:, d // 2 :] = m[:, :1]
    r = np.triu(np.linalg.qr(m, mode="r"))
    a, b, _ = W.bidiagonalise(r)
    want = np.linalg.svd(r, compute_uv=False)
    np.testing.assert_allclose(np.sqrt(W.dqds(a, b)), want, atol=1e-13 * want[0])
    squares, v = W.principal_directions(r, 4)
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-12
    assert np.abs(r.T @ (r @ v) - v * squares).max() < 1e-12 * squares[0]


def test_small_singular_values_are_relatively_accurate():
    """dqds on a bidiagonal matrix whose values span forty orders of magnitude."""
    a = np.logspace(0, -20, 9)
    b = a[:-1] * 0.5
    exact = [Fraction(float(x)) for x in a]
    # det(B'B) is the product of the squares: exact in fractions
    product = Fraction(1)
    for x in exact:
        product *= x * x
    got = W.dqds(a, b)
    assert abs(sum(math.log(g) for g in got) - float(math.log(product.numerator) - math.log(product.denominator))) < 1e-12
