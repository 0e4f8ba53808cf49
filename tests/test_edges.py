"""Edge fixtures (FIXTURES.md §3) and the shared contract of the tools (§2.0)."""

from __future__ import annotations

import datetime as dt

import pytest

from drillspark.functions.columns import OperatorError, resolve_table
from drillspark.operators.customers import funnel
from drillspark.operators.describe import describe
from drillspark.operators.profile import histogram, profile
from drillspark.operators.series import growth_rates
from drillspark.operators.stat_tests import correlation, t_test


def test_resolve_table(spark):
    a = spark.createDataFrame([(1, 2.0)], "own_goals int, x double")
    b = spark.createDataFrame([(1, "n")], "own_goals int, name string")
    tables = {"games": a, "players": b}
    assert resolve_table(tables, {"column": "x"}) == "games"
    assert resolve_table(tables, {"column": "name"}) == "players"
    assert resolve_table(tables, {"column": "own_goals"}) == "games"  # primary preferred
    assert resolve_table(tables, {"columns": ["name", "own_goals"]}) == "players"  # lists are looked into
    assert resolve_table(tables, {"method": "iqr"}) == "games"  # nothing named -> primary
    assert resolve_table(tables, {"column": "x"}, explicit="players") == "players"
    with pytest.raises(OperatorError):
        resolve_table(tables, {"a": "x", "b": "name"})


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "x double")
    d = describe(empty, "x").first()
    assert d["count"] == 0 and d["null_fraction"] == 0.0 and d["caveats"] == ["every value of the column is missing"]
    nulls = spark.createDataFrame([(None,), (None,)], "x double")
    d2 = describe(nulls, "x").first()
    assert d2["count"] == 0 and d2["null_fraction"] == 1.0 and d2["median"] is None
    prof = profile(spark.createDataFrame([(None, "a")], "x double, y string")).collect()
    assert prof[0]["null_fraction"] == 1.0 and prof[0]["distinct_count"] == 0 and prof[0]["sample_values"] == []
    assert histogram(empty, "x").count() == 0


def test_single_row_and_constant(spark):
    one = spark.createDataFrame([(5.0,)], "x double")
    d = describe(one, "x").first()
    assert d["median"] == 5.0 and d["p25"] == 5.0 and d["stddev"] is None
    const = spark.createDataFrame([(2.0,)] * 7, "x double")
    h = histogram(const, "x").collect()
    assert sum(r["count"] for r in h) == 7 and len(h) == 5


def test_perfect_correlation_and_zero_denominators(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(10)], "x double, y double")
    r = correlation(df, "x", "y").first()
    assert r["r"] == 1.0 and r["p_value"] == 0.0
    g = spark.createDataFrame(
        [(dt.date(2024, 1, 1), 0.0), (dt.date(2024, 2, 1), 5.0), (dt.date(2024, 3, 1), 5.0)], "d date, v double"
    )
    pct = [x["pct_change"] for x in growth_rates(g, "d", "v").table.collect()]
    assert pct == [None, None, 0.0]  # previous 0 -> null, never a division error
    stages = spark.createDataFrame([("u1", "signup")], "u string, s string")
    t = funnel(stages, "u", "s", ["view", "signup"]).table.collect()
    assert [x["pct_of_start"] for x in t] == [None, None]


def test_two_group_errors(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (3.0, "b")], "x double, g string")
    with pytest.raises(Exception, match=">=2 values"):
        t_test(df, "x", "g", "a", "b").collect()
    single = spark.createDataFrame([(1.0, "a"), (2.0, "a")], "x double, g string")
    with pytest.raises(Exception, match="into two groups"):
        t_test(single, "x", "g").collect()


def test_run_tool_resolves_its_table(spark):
    from drillspark.plans.tools import TOOLS, run_tool

    games = spark.createDataFrame([(i, float(i)) for i in range(10)], "game long, goals double")
    players = spark.createDataFrame([(f"p{i % 2}", float(i), float(-i)) for i in range(12)], "team string, goals double, age double")
    tables = {"games": games, "players": players}
    assert len(TOOLS) == 18
    assert run_tool(tables, "describe", column="goals").first()["count"] == 10  # the primary table has it
    assert run_tool(tables, "describe", table="players", column="goals").first()["count"] == 12
    assert run_tool(tables, "t_test", value="age", group="team").first()["n_a"] == 6
    assert run_tool(tables, "correlation", x="goals", y="age").first()["r"] == -1.0
    for name, inputs in (("nothing", {}), ("correlation", {"x": "game", "y": "age"})):
        with pytest.raises(OperatorError):
            run_tool(tables, name, **inputs)
