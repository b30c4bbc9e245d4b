"""Token totals, prices, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def simple_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars at prices a million tokens; null without a price."""
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def cached_cost(tokens_in: Column, cached: Column, tokens_out: Column, price_in: Column, price_cached: Column, price_out: Column) -> Column:
    return ((tokens_in - cached) * price_in + cached * price_cached + tokens_out * price_out) / 1e6


def at_least_one(n: Column) -> Column:
    return F.greatest(n, F.lit(1))


def run_metrics(calls: DataFrame, by: list[str]) -> DataFrame:
    """Of calls (ts, value: seconds, answer) n_calls, errors, the wall time from the first to the last,
    that for each call, and the mean seconds of a call."""
    wall = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    errors = F.count_if(F.startswith("answer", F.lit("ERROR"))).alias("errors")
    return calls.groupBy(*by).agg(F.count("*").alias("n_calls"), errors, F.round(wall, 1).alias("wall_s"), F.round(wall / F.greatest(F.count("*"), F.lit(1)), 2).alias("s_per_prompt"), F.round(F.avg("value"), 2).alias("mean_call_s"))
