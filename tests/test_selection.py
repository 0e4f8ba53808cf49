"""Selection by histogram refinement against sorting."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from drillspark.functions.ranks import exact_quantiles
from drillspark.functions.selection import value_at


def ordered(values):
    """Ascending, NaN before null at the end."""
    plain = [v for v in values if v is not None and v == v]
    return sorted(plain) + [v for v in values if v is not None and v != v] + [None] * sum(v is None for v in values)


def check(spark, values, dtype, positions=None):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}").repartition(3)
    positions = range(len(values)) if positions is None else positions
    targets = spark.createDataFrame([(i, p) for i, p in enumerate(positions)], "pid int, pos long")
    want = ordered(values)
    for ties in (True, False) if len(values) > 10 else (True,):
        got = {r.pid: (r.v, r.rel) for r in value_at(df, [], "v", targets, ties=ties).collect()}
        assert len(got) == sum(p < len(values) for p in positions)
        for i, p in enumerate(positions):
            if p >= len(values):
                continue
            same = got[i][0] == want[p] or (got[i][0] is None and want[p] is None) or (got[i][0] != got[i][0] and want[p] != want[p])
            assert same, (p, got[i], want[p])
            if ties:
                key = lambda x: (x is None, x != x, 0 if x is None or x != x else x)
                assert got[i][1] == p - min(q for q in range(len(want)) if key(want[q]) == key(want[p]))


def test_every_position_of_awkward_columns(spark):
    nan, inf = float("nan"), float("inf")
    check(spark, [3.5, None, nan, -inf, inf, 0.0, -0.0, 3.5, 1e308, -1e308, 5e-324, 2.0, None, nan], "double")
    check(spark, [2**63 - 1, -(2**63), 2**53 + 1, 2**53, 0, -1, None, 2**53], "long")
    check(spark, ["Customer#000000017", "Customer#000000002", "Customer#", "", None, "Ω", "é", "Customer#000000002", "a\x00", "a"], "string")
    check(spark, [None, None], "double")
    check(spark, [], "double", [0])
    check(spark, [1.0], "double", [0, 1, 5])


def test_values_of_very_different_sizes(spark):
    rnd = random.Random(4)
    values = [math.exp(rnd.uniform(-600, 600)) * rnd.choice([1, -1]) for _ in range(3000)]
    check(spark, values, "double", [0, 1, 700, 1499, 1500, 2998, 2999])


def test_quantiles_per_group_with_a_hot_one(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.lognormal(3, 2, 4000)] + [("flat", 7.0)] * 1000 + [(None, float(v)) for v in range(5)]
    rows += [("none", None), ("one", 1.5)] + [(f"g{i % 50}", float(v)) for i, v in enumerate(rng.normal(size=700))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.975, 1.0]
    got = {r.g: r for r in exact_quantiles(df, "v", probs, by=["g"]).collect()}
    assert len(got) == 55 and got["none"].n == 0 and got["none"].q2 is None
    for g in set(r[0] for r in rows) - {"none"}:
        values = [v for k, v in rows if k == g]
        np.testing.assert_allclose([got[g][f"q{i}"] for i in range(5)], np.quantile(values, probs), rtol=1e-12)
        assert got[g].n == len(values)


def test_a_pass_returns_a_row_for_each_target(spark, monkeypatch):
    """Whatever the table's size; in a few passes, with nothing written."""
    from drillspark.functions import ranks, selection

    sizes, held = [], selection.Held.__init__

    def watched(self, *args):
        held(self, *args)
        sizes.append(self.df.count())

    monkeypatch.setattr(selection.Held, "__init__", watched)
    monkeypatch.setattr(selection, "checkpointed", None)
    df = spark.range(200_000).select((F.rand(3) * F.exp(F.randn(4))).alias("v"))
    row = ranks.exact_quantiles(df, "v", [0.25, 0.5, 0.75]).first()
    want = np.quantile([r.v for r in df.collect()], [0.25, 0.5, 0.75])
    np.testing.assert_allclose([row.q0, row.q1, row.q2], want, rtol=1e-12)
    assert len(sizes) <= 6 and max(sizes) <= 6


def test_many_groups_are_written(spark, monkeypatch):
    from drillspark.functions import selection

    monkeypatch.setattr(selection, "FEW", 10)
    rows = [(i % 7, float((i * 37) % 101)) for i in range(400)]
    df = spark.createDataFrame(rows, "g long, v double")
    got = {r.g: (r.q0, r.q1) for r in exact_quantiles(df, "v", [0.3, 0.9], by=["g"]).collect()}
    for g in range(7):
        np.testing.assert_allclose(got[g], np.quantile([v for k, v in rows if k == g], [0.3, 0.9]))


def test_decimals_dates_and_flags(spark):
    from datetime import date, datetime
    from decimal import Decimal

    check(spark, [Decimal("1.01"), Decimal("1.02"), Decimal("9" * 36 + ".02"), Decimal("9" * 36 + ".01"), None], "decimal(38,2)")
    check(spark, [date(2024, 2, 29), date(1969, 12, 31), None, date(2024, 2, 29)], "date")
    check(spark, [datetime(2024, 1, 1, 0, 0, 1), datetime(2024, 1, 1), datetime(1960, 1, 1)], "timestamp")
    check(spark, [True, False, None, True], "boolean")


def test_unordered_types_are_refused(spark):
    df = spark.createDataFrame([([1],)], "v array<int>")
    with pytest.raises(ValueError):
        value_at(df, [], "v", spark.createDataFrame([(0, 0)], "pid int, pos long"))
