"""Conversion to US dollars with daily rates."""

from __future__ import annotations

from itertools import chain
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PairRates(NamedTuple):
    """Which daily rates convert a pair's quote and base currency."""

    symbol: str
    quote_rate: str
    base_rate: str


def check_pairs(pairs: list[PairRates]) -> list[PairRates]:
    """A rate has to end in ``usd`` and its currency has to be part of the pair's name."""
    for pair in pairs:
        for rate in (pair.quote_rate, pair.base_rate):
            if not rate.endswith("usd"):
                raise ValueError(f"not a USD rate: {rate}")
            if rate[:-3] not in pair.symbol:
                raise ValueError(f"incompatible pairs: {pair.symbol} - {rate}")
    return pairs


def rate_symbol(pairs: list[PairRates], side: str) -> Column:
    """The rate a row's symbol converts with; a symbol without an entry fails the query."""
    entries = [(F.lit(p.symbol), F.lit(getattr(p, side))) for p in check_pairs(pairs)]
    lookup = F.create_map(*chain.from_iterable(entries))
    unknown = F.raise_error(F.concat(F.lit("no USD rate given for "), F.col("symbol"))).cast("string")
    return F.coalesce(F.try_element_at(lookup, F.col("symbol")), unknown)


def join_rate(df: DataFrame, rates: DataFrame, symbol: Column, prefix: str) -> DataFrame:
    """Left join on day and rate symbol; adds ``<prefix>`` and ``<prefix>_average_daily_price``."""
    price = f"{prefix}_average_daily_price"
    dimension = rates.select("day", F.col("symbol").alias("_rate"), F.col("average_daily_price").alias(price))
    joined = df.withColumn("_rate", symbol).join(dimension, ["day", "_rate"], "left")
    return joined.withColumn(prefix, F.when(F.col(price).isNotNull(), F.col("_rate"))).drop("_rate")


def join_quote_rate(df: DataFrame, rates: DataFrame, pairs: list[PairRates]) -> DataFrame:
    return join_rate(df, rates, rate_symbol(pairs, "quote_rate"), "usd_rate")


def join_base_rate(df: DataFrame, rates: DataFrame, pairs: list[PairRates]) -> DataFrame:
    return join_rate(df, rates, rate_symbol(pairs, "base_rate"), "usd_rate_base_ccy")
