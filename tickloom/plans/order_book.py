"""The order-book series, its cleaning and its intraday breakdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import measures as m
from tickloom.functions import spreads as sp
from tickloom.functions.timeexpr import bucket_ms, day_arg_to_ms, day_of_ms, iso_instant, minute_of_day_ms
from tickloom.operators import book as ob
from tickloom.operators.cleaning import SPREAD_CAPS, outlier_filter, range_rules
from tickloom.operators.descriptive import describe
from tickloom.operators.grid import on_grid
from tickloom.operators.rates import PairRates, join_rate, rate_symbol
from tickloom.plans.zero_fill import cleaned_bars
from tickloom.session import stage
from tickloom.sources.schemas import BOOK_SERIES, CLEAN_SERIES

MULTIPLIERS = [1.0, 2.0, 3.0]
CLEAN_STATISTICS = [
    "bid_ask_spread", "bid_ask_spread_bps", "effective_spread_ob", "total_order_flow", "total_order_flow_usd",
    "avg_arbitrage_spread_as_midpoint_bips",
]


def trade_measures(bars: DataFrame, seconds: int) -> DataFrame:
    """Trade side of the series, per bucket; outlier prices removed first."""
    price, time = F.col("avg_price"), F.col("second")
    return (
        cleaned_bars(bars, seconds)
        .withColumn("bips", sp.spread_as_midpoint_bips())
        .groupBy("start_ts", "symbol")
        .agg(
            m.log_return(price, time).alias("return"),
            m.simple_return(price, time).alias("logreturn"),
            F.sum("total_number_of_trades").cast("double").alias("total_number_of_trades"),
            F.sum("total_volume").cast("double").alias("total_volume"),
            F.avg("avg_price").alias("avg_price"),
            F.avg(sp.price_parity()).alias("price_parity"),
            F.avg("arbitrage_spread").alias("avg_arbitrage_spread"),
            F.avg("arbitrage_profit").alias("avg_arbitrage_profit"),
            F.avg("bips").alias("avg_arbitrage_spread_as_midpoint_bips"),
            F.sum("total_order_flow").alias("total_order_flow"),
        )
        .withColumn("avg_trade_size", F.try_divide("total_volume", "total_number_of_trades"))
    )


def order_book_series(book: DataFrame, bars: DataFrame, seconds: int = 60, thin_book: str = "extend") -> DataFrame:
    """Spread, midpoint, imbalance and trade measures per bucket, from each bucket's earliest snapshot.

    The book, by far the largest input, is read in two passes: one over (symbol, date) for the
    snapshot times, one joined with those times. Only buckets with trades are looked up, and the
    lookup table is staged so that the planner knows its size when it picks the join.
    """
    trades = trade_measures(bars, seconds)
    wanted = stage(ob.snapshot_times(book, seconds).join(trades, ob.GROUP), "book-times")
    levels = ob.banded_levels(ob.snapshot_levels(book, wanted))
    sizes = wanted.select(*ob.GROUP, F.col("avg_trade_size").alias("size"))
    measured = ob.book_measures(levels, sizes, MULTIPLIERS, thin_book)
    return (
        measured.where(F.col("bid_ask_spread").isNotNull())
        .join(wanted.drop("date"), ob.GROUP)
        .withColumn("effective_spread_ob", sp.effective_spread())
        .withColumn("date_display", iso_instant(F.col("start_ts")))
        .withColumnRenamed("start_ts", "start_ts_ob")
        .select(*BOOK_SERIES.names)
    )


def clean_book_series(
    series: DataFrame, rates: DataFrame, pairs: list[PairRates], outlier_seconds: int
) -> DataFrame:
    """Series (read twice) without implausible or outlying spreads, with spread in bps and flow in dollars.

    Order flow is in base currency; unlike elsewhere a missing rate leaves the dollar flow unknown.
    """
    capped = series.where(range_rules(SPREAD_CAPS)).withColumn(
        "outlier_group_ts", bucket_ms(F.col("start_ts_ob"), outlier_seconds)
    )
    kept = outlier_filter(capped, ["symbol", "outlier_group_ts"], "bid_ask_spread", bounded=True).drop("outlier_group_ts")
    dated = kept.withColumn("bid_ask_spread_bps", sp.as_bps("bid_ask_spread")).withColumn(
        "day", day_of_ms(F.col("start_ts_ob"))
    )
    priced = join_rate(dated, rates, rate_symbol(pairs, "base_rate"), "usd_rate")
    flow = F.col("total_order_flow") * F.col("usd_rate_average_daily_price")
    return priced.withColumn("total_order_flow_usd", flow).select(*CLEAN_SERIES.names)


def clean_book_statistics(clean: DataFrame) -> DataFrame:
    """All six statistics rows from one pass over the clean series."""
    return describe(clean, CLEAN_STATISTICS)


def book_intraday_breakdown(
    series: DataFrame, first_day: str, end_day: str, seconds: int = 60, group_seconds: int = 3600,
    skip_empty: bool = False,
) -> DataFrame:
    """Average quoted and effective spread (bps) by minute of day. ``series`` is read twice; pass a table.

    A group without data enters the average as 0 unless ``skip_empty``.
    """
    spreads = ["effective_spread_as_bps", "bid_ask_spread_as_bps"]
    measured = series.select(
        "start_ts_ob", "symbol",
        sp.as_bps("effective_spread_ob").alias("effective_spread_as_bps"),
        sp.as_bps("bid_ask_spread").alias("bid_ask_spread_as_bps"),
    )
    grid = on_grid(measured, "start_ts_ob", day_arg_to_ms(first_day), day_arg_to_ms(end_day), seconds * 1000)
    group_average = F.avg if skip_empty else (lambda c: m.avg_if_not_null(F.col(c)))
    groups = grid.groupBy(bucket_ms(F.col("start"), group_seconds).alias("group_ts"), "symbol").agg(
        *[group_average(c).alias(c) for c in spreads]
    )
    return groups.groupBy(
        minute_of_day_ms(F.col("group_ts"), 1).alias("start_minute_of_day"), "symbol"
    ).agg(*[m.avg_if_not_null(F.col(c)).alias(c) for c in spreads])
