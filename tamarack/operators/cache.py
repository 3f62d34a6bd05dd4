"""Results kept by content, and what their use costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(requests: DataFrame, stored: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(requests with their stored result, requests that have none)."""
    return requests.join(stored, key), requests.join(stored.select(key), key, "left_anti")


def estimated_cost(prompt_tokens: Column, completion_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Price per million tokens; null where the price is unknown; six decimals."""
    return F.round((prompt_tokens * input_price + completion_tokens * output_price) / 1_000_000, 6)


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage with ``cost`` by a price list (model, input_price, output_price)."""
    cost = estimated_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("input_price"), F.col("output_price"))
    return usage.join(prices, "model", "left").withColumn("cost", cost).drop("input_price", "output_price")


def hit_rate(hits: Column, calls: Column) -> Column:
    return F.when(calls > 0, hits / calls).otherwise(0.0)
