"""Fitting a small model over blocks of rows by iterative parameter mixing.

The training rows are packed into ``blocks`` blocks, written once as a table.
In each round every block trains from the shared parameters by itself, on the
executors, and the parameter vectors are averaged by the rows behind them
(McDonald, Hall & Mann 2010). Only parameter vectors reach the driver; a lost
executor costs the repetition of its blocks' round.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def held_out(id_col: Column) -> Column:
    """Rows that no model learns from: CRC-32 of the id's text leaves 2 when
    divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def label_sample(labels: DataFrame, id_col: str, label_col: str, values: list, per_value: int) -> DataFrame:
    """At most ``per_value`` labelled, not held-out ids of each label value,
    those with the smallest hashes. Ids with several labels take the most
    common (of equal counts the smaller); null ids and labels are left out."""
    counted = labels.where(f"{id_col} IS NOT NULL AND {label_col} IS NOT NULL").where(~held_out(F.col(id_col)))
    counted = counted.groupBy(id_col, label_col).agg(F.count(F.lit(1)).alias("n"))
    one = counted.groupBy(id_col).agg(F.max_by(label_col, F.struct("n", -F.col(label_col))).alias(label_col))
    picks = [one.where(F.col(label_col) == v).orderBy(F.xxhash64(id_col), id_col).limit(per_value) for v in values]
    out = picks[0]
    for p in picks[1:]:
        out = out.unionByName(p)
    return out


def texts_of(documents: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, label, __text) for the sampled (__id, label): one text an id, whatever
    the number of rows that share it (the smallest of their texts), so the sample is
    bounded by its ids."""
    texts = documents.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    # a few thousand ids (the sample's parameter), sent to the texts
    rows = texts.join(F.broadcast(sample), "__id")
    if rows.groupBy("__id").count().where("count > 1").isEmpty():  # reads ids only
        return rows
    return rows.groupBy("__id", "label").agg(F.min("__text").alias("__text"))


def pack_blocks(rows: DataFrame, id_col: str, blocks: int) -> DataFrame:
    """``rows`` as a written table of one row a block: an Arrow stream of the
    block's rows in a fixed order. For bounded training samples only."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__order", "ascending"), (id_col, "ascending")]).drop_columns(["__order", "__block"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return pa.table({"block": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    order = F.xxhash64(F.lit(7), id_col)
    keyed = rows.withColumn("__order", order).withColumn("__block", F.pmod(order, F.lit(blocks)))
    return checkpointed(keyed.groupBy("__block").applyInArrow(pack, "block binary"))


def over_blocks(table: DataFrame, work: Callable[[pa.Table], tuple[np.ndarray, float]]) -> list[tuple[np.ndarray, float]]:
    """``work`` on every block: a vector and a weight from each."""

    def run(batches):
        for batch in batches:
            for block in batch.column("block"):
                rows = pa.ipc.open_stream(block.as_py()).read_all()
                vector, weight = work(rows)
                made = np.ascontiguousarray(vector, np.float64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary()), pa.array([float(weight)])], ["v", "w"])

    found = table.mapInArrow(run, "v binary, w double").collect()  # one vector for each of the blocks
    return sorted(((np.frombuffer(bytes(r.v)), r.w) for r in found), key=lambda x: (x[1], x[0].tobytes()))


def mix(
    table: DataFrame,
    start: np.ndarray,
    work: Callable[[pa.Table, np.ndarray, int], tuple[np.ndarray, float]],
    rounds: int,
) -> np.ndarray:
    """The parameters after ``rounds`` rounds of local training and averaging."""
    params = start
    for r in range(rounds):
        found = over_blocks(table, lambda rows, p=params, r=r: work(rows, p, r))
        total = sum(w for _, w in found)
        if not total:
            return params
        params = sum(v * w for v, w in found) / total
    return params


class Adam:
    """Adam steps on one flat parameter vector."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, params: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        m, v = self.m / (1 - 0.9**self.t), self.v / (1 - 0.999**self.t)
        return params - self.rate * m / (np.sqrt(v) + 1e-8)
