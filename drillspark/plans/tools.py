"""One entry for the analyst tools: pick the table, run the operator."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..functions.columns import OperatorError, resolve_table
from ..operators import change, customers, describe, models, series, stat_tests

TOOLS = {
    fn.__name__: fn
    for fn in (
        describe.describe, describe.outliers, describe.fit_distribution,
        change.decompose_contribution, change.volume_vs_rate,
        stat_tests.t_test, stat_tests.mann_whitney, stat_tests.chi_square,
        stat_tests.correlation, stat_tests.correlation_matrix,
        series.moving_average, series.growth_rates, series.trend,
        models.linear_fit, models.logistic_fit,
        customers.cohort_retention, customers.funnel, customers.rfm,
    )
}


def run_tool(tables: Mapping[str, DataFrame], name: str, table: str | None = None, **inputs):
    """Run the tool ``name`` on one of several loaded tables: the named one, or
    the first (the primary table first) that has all columns the inputs name.
    Returns what the operator returns."""
    if name not in TOOLS:
        raise OperatorError(f"there is no tool {name!r}; there are {', '.join(sorted(TOOLS))}")
    return TOOLS[name](tables[resolve_table(tables, inputs, table)], **inputs)
