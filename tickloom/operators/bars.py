"""Trades to bars: per exchange, then across exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import measures as m
from tickloom.functions.spreads import arbitrage_profit, arbitrage_spread
from tickloom.functions.timeexpr import bucket_ms, day_of_ms


def in_range(trades: DataFrame, first_ms: int, last_ms: int) -> DataFrame:
    """Inclusive on both ends, so the first millisecond of the closing day is kept."""
    return trades.where(F.col("date").between(first_ms, last_ms))


def exchange_bars(trades: DataFrame, seconds: int) -> DataFrame:
    """One row per (bar, exchange, symbol); combined map-side before its only shuffle.

    Only the count and four sums cross the shuffle; totals and flow follow from the two sides. The sums don't depend on
    the order of the rows: the least noise in a price decides which exchange has the best one.
    """
    amount = m.number(F.col("amount"))
    notional = m.number(F.col("price")) * amount
    sells = m.is_sell(F.col("sell"))

    def side(value, condition):
        return F.when(condition, value).otherwise(F.lit(0.0))

    names = ["notional_bid", "volume_trades_bid", "notional_ask", "volume_trades_ask"]
    sums = (
        trades.select(
            bucket_ms(F.col("date"), seconds).alias("start_ms"),
            "exchange",
            "symbol",
            side(notional, ~sells).alias("notional_bid"),
            side(amount, ~sells).alias("volume_trades_bid"),
            side(notional, sells).alias("notional_ask"),
            side(amount, sells).alias("volume_trades_ask"),
        )
        .groupBy("start_ms", "exchange", "symbol")
        .agg(F.count("*").alias("number_of_trades"), *[m.exact_sum(F.col(name)).alias(name) for name in names])
    )

    def price(numerator, denominator):
        return F.coalesce(F.try_divide(numerator, denominator), F.lit(m.NAN))

    bid_notional, ask_notional = F.col("notional_bid"), F.col("notional_ask")
    bid_volume, ask_volume = F.col("volume_trades_bid"), F.col("volume_trades_ask")
    return sums.select(
        "start_ms",
        "exchange",
        "symbol",
        "number_of_trades",
        price(bid_notional + ask_notional, bid_volume + ask_volume).alias("price"),
        (bid_volume + ask_volume).alias("amount"),
        (bid_volume - ask_volume).alias("order_flow"),
        price(bid_notional, bid_volume).alias("price_trades_bid"),
        price(ask_notional, ask_volume).alias("price_trades_ask"),
        "volume_trades_bid",
        "volume_trades_ask",
    )


def cross_exchange_bars(bars: DataFrame, nan_policy: str = "propagate") -> DataFrame:
    """One row per (bar, symbol) with the best ask and bid over the exchanges and the arbitrage between them.

    By default an exchange without buys makes ``max_price_trades_bid`` NaN (NaN is the largest
    number); ``nan_policy="ignore"`` leaves such exchanges out.
    """
    if nan_policy not in ("propagate", "ignore"):
        raise ValueError(f"unknown nan_policy {nan_policy!r}")
    ask, bid, exchange = F.col("price_trades_ask"), F.col("price_trades_bid"), F.col("exchange")
    best_bid = F.max(bid)
    if nan_policy == "ignore":
        best_bid = F.coalesce(F.max(F.when(~F.isnan(bid), bid)), F.lit(m.NAN))

    # Per side one minimum over (price, exchange, ...) picks all "of the best price" columns at once;
    # equal prices go to the smallest exchange name.
    def pick(price, usable, side_volume):
        return F.min(F.when(usable, F.struct(
            price.alias("price"), exchange, F.col("order_flow").alias("flow"), F.col(side_volume).alias("volume")
        )))

    nothing = F.struct(
        F.lit(m.NAN).alias("price"), F.lit("").alias("exchange"), F.lit(0.0).alias("flow"), F.lit(0.0).alias("volume")
    )
    grouped = bars.groupBy("start_ms", "symbol").agg(
        F.sum("number_of_trades").alias("total_number_of_trades"),
        m.vwap(F.col("price"), F.col("amount")).alias("avg_price"),
        m.volume(F.col("amount")).alias("total_volume"),
        F.min("price_trades_ask").alias("min_price_trades_ask"),
        F.coalesce(pick(ask, ~F.isnan(ask), "volume_trades_ask"), nothing).alias("ask"),
        best_bid.alias("max_price_trades_bid"),
        F.coalesce(pick(-bid, m.is_positive(bid), "volume_trades_bid"), nothing).alias("bid"),
        F.sum("order_flow").alias("total_order_flow"),
    )
    return (
        grouped.select(
            F.timestamp_millis("start_ms").alias("start_second"),
            "symbol",
            "total_number_of_trades",
            "avg_price",
            "total_volume",
            "min_price_trades_ask",
            F.col("ask.exchange").alias("exchange_of_min_price_trades_ask"),
            F.col("ask.flow").alias("order_flow_of_min_price_trades_ask"),
            F.col("ask.volume").alias("volume_of_min_price_trades_ask"),
            "max_price_trades_bid",
            F.col("bid.exchange").alias("exchange_of_max_price_trades_bid"),
            F.col("bid.flow").alias("order_flow_of_max_price_trades_bid"),
            F.col("bid.volume").alias("volume_of_max_price_trades_bid"),
            "total_order_flow",
        )
        .withColumn("arbitrage_spread", arbitrage_spread())
        .withColumn("arbitrage_profit", arbitrage_profit())
    )


def open_close_bars(trades: DataFrame, seconds: int) -> DataFrame:
    """Open, close and range return per (bar, symbol): the range runs over the exchanges' opens and closes."""
    per_exchange = (
        trades.select(
            bucket_ms(F.col("date"), seconds).alias("start_ms"), "exchange", "symbol", "date", "price", "id"
        )
        .groupBy("start_ms", "exchange", "symbol")
        .agg(
            m.opening(m.number(F.col("price")), F.struct("date", "id")).alias("price_open"),
            m.closing(m.number(F.col("price")), F.struct("date", "id")).alias("price_close"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
    )
    return per_exchange.groupBy("start_ms", "symbol").agg(
        m.opening(F.col("price_open"), F.struct("first_date", "exchange")).alias("price_open"),
        m.closing(F.col("price_close"), F.struct("last_date", "exchange")).alias("price_close"),
        m.range_return(F.col("price_open"), F.col("price_close")).alias("range_return"),
    )


def daily_prices(trades: DataFrame) -> DataFrame:
    return (
        trades.select(day_of_ms(F.col("date")).alias("day"), "symbol", "price", "amount")
        .groupBy("day", "symbol")
        .agg(
            F.count("*").alias("number_of_trades"),
            F.sum("amount").alias("total_amount"),
            m.vwap(F.col("price"), F.col("amount")).alias("average_daily_price"),
        )
    )
