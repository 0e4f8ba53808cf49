"""Usage accounting (U1): cost of model calls per model and in total.

cost = (input + 1.25 * cache_write + 0.1 * cache_read) * input_price
       + output * output_price, per million tokens;
uncached cost prices every input token (cache reads and writes included) at
the plain input price; savings = uncached - cost. Prices are an input table
(model, input_price, output_price); a model without a price uses the default.
``as_model`` adds the counterfactual: the same usage priced at one model's
rate, and what routing saved against it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cache multipliers and the fallback price ($ per 1M tokens).
CACHE_WRITE_MULT = 1.25
CACHE_READ_MULT = 0.10
DEFAULT_PRICE = (5.0, 25.0)


class Usage(NamedTuple):
    per_model: DataFrame  # model, calls, token sums, cost, uncached_cost, savings
    total: DataFrame  # one row


def _cost(inp: Column, out: Column, cr: Column, cw: Column, ip: Column, op: Column) -> Column:
    return (
        inp * ip + cw * ip * F.lit(CACHE_WRITE_MULT) + cr * ip * F.lit(CACHE_READ_MULT) + out * op
    ) / F.lit(1_000_000.0)


def _uncached(inp: Column, out: Column, cr: Column, cw: Column, ip: Column, op: Column) -> Column:
    return ((inp + cr + cw) * ip + out * op) / F.lit(1_000_000.0)


def usage_cost(calls: DataFrame, prices: DataFrame, as_model: str | None = None) -> Usage:
    """calls: model, input_tokens, output_tokens, cache_read_tokens,
    cache_write_tokens (one row per call). Token sums per model come from one
    aggregation; the price table (one row per model, small by nature) is
    joined afterwards, to the per-model sums only."""
    tok = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]
    per = calls.groupBy(F.coalesce(F.col("model"), F.lit("unknown")).alias("model")).agg(
        F.count(F.lit(1)).alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in tok]
    )
    p = prices.select("model", F.col("input_price").cast("double").alias("_ip"), F.col("output_price").cast("double").alias("_op"))
    j = per.join(p, "model", "left")
    ip = F.coalesce(F.col("_ip"), F.lit(DEFAULT_PRICE[0]))
    op = F.coalesce(F.col("_op"), F.lit(DEFAULT_PRICE[1]))
    args = [F.col(c).cast("double") for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")]
    j = j.withColumn("cost", _cost(*args, ip, op)).withColumn("uncached_cost", _uncached(*args, ip, op))
    j = j.withColumn("savings", F.col("uncached_cost") - F.col("cost"))
    if as_model is not None:
        ref = p.where(F.col("model") == as_model).select(F.col("_ip").alias("_aip"), F.col("_op").alias("_aop"))
        j = j.crossJoin(F.broadcast(ref.unionByName(
            p.sparkSession.createDataFrame([(None, None)], "_aip double, _aop double")
        ).agg(F.max("_aip").alias("_aip"), F.max("_aop").alias("_aop"))))
        aip = F.coalesce(F.col("_aip"), F.lit(DEFAULT_PRICE[0]))
        aop = F.coalesce(F.col("_aop"), F.lit(DEFAULT_PRICE[1]))
        j = j.withColumn("cost_as_model", _cost(*args, aip, aop)).drop("_aip", "_aop")
    per_model = j.drop("_ip", "_op")
    sums = [F.sum(c).alias(c) for c in ["calls", *tok, "cost", "uncached_cost"]]
    if as_model is not None:
        sums.append(F.sum("cost_as_model").alias("cost_as_model"))
    total = per_model.agg(*sums).withColumn("savings", F.col("uncached_cost") - F.col("cost"))
    total = total.withColumn(
        "savings_pct",
        F.when(F.col("uncached_cost") > 0, F.col("savings") / F.col("uncached_cost") * F.lit(100.0)).otherwise(F.lit(0.0)),
    )
    if as_model is not None:
        total = total.withColumn("routing_savings", F.col("cost_as_model") - F.col("cost"))
    return Usage(per_model, total)
