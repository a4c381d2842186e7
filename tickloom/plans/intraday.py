"""Intraday seasonality of trading activity and of returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import measures as m
from tickloom.functions import spreads as sp
from tickloom.functions.timeexpr import (
    bucket_ms, bucket_s_to_ms, day_arg_to_ms, day_of_ms, minute_of_day_ms,
)
from tickloom.operators.cleaning import PRICE_RANGES, day_rules, range_rules
from tickloom.operators.grid import on_grid, zero_fill
from tickloom.operators.rates import PairRates, join_base_rate, join_quote_rate
from tickloom.session import stage
from tickloom.sources.schemas import INTRADAY_BREAKDOWN

SUMS = ["total_number_of_trades", "total_volume_in_usd", "total_order_flow_in_usd", "arbitrage_profit_in_usd"]
MEANS = ["arbitrage_spread_as_midpoint_bips", "price_parity"]


def filled_bins(
    bars: DataFrame, rates: DataFrame, pairs: list[PairRates], first_day: str, end_day: str, seconds: int = 300
) -> DataFrame:
    """Dollar measures per bin on the full grid; sums and returns are 0 and means null in empty bins.

    A bin lies within one day and so has one rate: bins are summed first and converted afterwards.
    """
    second = F.unix_seconds("start_second")
    price = F.col("avg_price")
    bins = (
        bars.where(day_rules() & range_rules(PRICE_RANGES) & sp.price_is_known())
        .withColumn("second", second)
        .withColumn("start_ts", bucket_s_to_ms(second, seconds))
        .withColumn("arbitrage_spread_as_midpoint_bips", sp.spread_as_midpoint_bips())
        .groupBy("start_ts", "symbol")
        .agg(
            m.log_return(price, F.col("second")).alias("return"),
            m.simple_return(price, F.col("second")).alias("logreturn"),
            F.sum("total_number_of_trades").alias("total_number_of_trades"),
            F.sum("total_volume").alias("total_volume"),
            F.sum("total_order_flow").alias("total_order_flow"),
            F.sum("arbitrage_profit").alias("arbitrage_profit"),
            F.avg("arbitrage_spread_as_midpoint_bips").alias("arbitrage_spread_as_midpoint_bips"),
            F.avg(sp.price_parity()).alias("price_parity"),
        )
        .withColumn("day", day_of_ms(F.col("start_ts")))
    )
    priced = join_base_rate(join_quote_rate(bins, rates, pairs), rates, pairs).select(
        "start_ts", "symbol", "return", "logreturn", "total_number_of_trades",
        sp.in_usd("total_volume", "usd_rate_base_ccy_average_daily_price").alias("total_volume_in_usd"),
        sp.in_usd("total_order_flow", "usd_rate_base_ccy_average_daily_price").alias("total_order_flow_in_usd"),
        sp.in_usd("arbitrage_profit", "usd_rate_average_daily_price").alias("arbitrage_profit_in_usd"),
        *MEANS,
    )
    # the bins are read for their symbols and for the grid; stage them rather than aggregate twice
    grid = on_grid(stage(priced, "bins"), "start_ts", day_arg_to_ms(first_day), day_arg_to_ms(end_day), seconds * 1000)
    return zero_fill(grid, ["return", "logreturn", *SUMS])


def _day_total(column: str):
    """Total over the rows of one symbol's day, at most 86,400 / bin length of them."""
    return F.sum(column).over(Window.partitionBy("symbol", "day"))


def intraday_breakdown(bins: DataFrame, group_seconds: int = 3600) -> DataFrame:
    """Average activity, and share of the day's activity, by minute of day."""
    groups = (
        bins.groupBy(bucket_ms(F.col("start"), group_seconds).alias("group_ts"), "symbol")
        .agg(*[F.sum(c).alias(c) for c in SUMS], *[F.avg(c).alias(c) for c in MEANS])
        .withColumn("day", day_of_ms(F.col("group_ts")))
    )
    shared = ["total_volume_in_usd", "total_number_of_trades", "arbitrage_profit_in_usd"]
    shares = groups.select(
        "*", *[sp.share_of(F.col(c), _day_total(c)).alias(f"{c}_as_daily_percentage") for c in shared]
    )
    return shares.groupBy(
        minute_of_day_ms(F.col("group_ts"), max(1, group_seconds // 60)).alias("start_minute_of_day"), "symbol"
    ).agg(
        *[F.avg(f"{c}_as_daily_percentage").alias(f"avg_{c}_as_daily_percentage") for c in shared],
        *[F.avg(c).alias(c) for c in SUMS],
        m.avg_if_not_null(F.col("arbitrage_spread_as_midpoint_bips")).alias("avg_arbitrage_spread_as_midpoint_bips"),
        m.avg_if_not_null(F.col("price_parity")).alias("avg_price_parity"),
    ).select(*INTRADAY_BREAKDOWN.names)


def intraday_variance(bins: DataFrame, group_seconds: int = 3600) -> DataFrame:
    """Average realized variance, and share of the day's variance, by minute of day."""
    square = F.col("logreturn") * F.col("logreturn")
    squares = bins.select("start", "symbol", day_of_ms(F.col("start")).alias("day"), square.alias("square_logreturns"))
    share = sp.share_of(F.col("square_logreturns"), _day_total("square_logreturns"))
    groups = (
        squares.withColumn("share", share)
        .groupBy(bucket_ms(F.col("start"), group_seconds).alias("group_ts"), "symbol")
        .agg(
            F.sum("share").alias("variance_logreturns_as_daily_percentage"),
            F.sum("square_logreturns").alias("variance_logreturns"),
        )
    )
    return groups.groupBy(
        minute_of_day_ms(F.col("group_ts"), max(1, group_seconds // 60)).alias("start_minute_of_day"), "symbol"
    ).agg(
        F.avg("variance_logreturns_as_daily_percentage").alias("avg_variance_logreturns_as_daily_percentage"),
        F.avg("variance_logreturns").alias("variance_logreturns"),
    )
