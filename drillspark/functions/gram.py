"""Cross-product matrices of many columns in one pass.

Each task multiplies its Arrow batches as matrices (a few numbers a column pair and
batch, whatever the rows) and returns one partial result; partial results are merged
in two levels of bounded groups. One expression for each pair of columns, as a SQL
aggregation has, would not get past some hundred columns: code for 300 columns has
45,150 of them.

Centred sums are merged by the update of Chan, Golub & LeVeque (1983), so large means
do not drown the variances.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_GROUPS = 64
_STATE = "part long, n long, mean array<double>, cross array<double>"


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    """The columns of a batch (numbers without nulls) as a matrix."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])


def _merged(a: tuple, b: tuple) -> tuple:
    (na, ma, ca), (nb, mb, cb) = a, b
    if not na or not nb:
        return a if na else b
    d = mb - ma
    return na + nb, ma + d * (nb / (na + nb)), ca + cb + np.outer(d, d) * (na * nb / (na + nb))


def _state(part: int, state: tuple) -> pa.RecordBatch:
    n, mean, cross = state
    cells = [pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([mean]), pa.array([cross.ravel()])]
    return pa.RecordBatch.from_arrays(cells, ["part", "n", "mean", "cross"])


def moments(df: DataFrame) -> DataFrame:
    """One row for the (double, non-null) columns of ``df``: ``n``, their ``mean`` and
    ``cross``, the centred cross-products row by row. n is 0 for no rows."""
    k = len(df.columns)
    empty = (0, np.zeros(k), np.zeros((k, k)))

    def partial(batches):
        state = empty
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch)
                mean = x.mean(axis=0)
                state = _merged(state, (len(x), mean, (x - mean).T @ (x - mean)))
        yield _state(TaskContext.get().partitionId(), state)

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        state = empty
        for n, mean, cross in zip(table["n"].to_pylist(), table["mean"], table["cross"]):
            state = _merged(state, (n, mean.values.to_numpy(), cross.values.to_numpy().reshape(k, k)))
        return pa.Table.from_batches([_state(table["part"][0].as_py(), state)])

    parts = df.mapInArrow(partial, _STATE)
    some = parts.groupBy(F.pmod("part", F.lit(_GROUPS))).applyInArrow(merge, _STATE)
    return some.groupBy(F.pmod("part", F.lit(1))).applyInArrow(merge, _STATE).drop("part")


def summed(df: DataFrame, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``work`` (a vector of ``size`` numbers) over the batches of ``df``."""

    def partial(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total = total + work(_rows(batch))
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total])], ["part", "v"])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = sum((v.values.to_numpy() for v in table["v"]), np.zeros(size))
        return pa.table({"part": table["part"][:1], "v": pa.array([total])})

    parts = df.mapInArrow(partial, "part long, v array<double>")
    some = parts.groupBy(F.pmod("part", F.lit(_GROUPS))).applyInArrow(merge, "part long, v array<double>")
    found = some.collect()  # _GROUPS rows at most
    return sum((np.array(r.v) for r in sorted(found, key=lambda r: r.part)), np.zeros(size))


def numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles, by position."""
    return df.select(*[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
