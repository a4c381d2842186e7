"""Monthly measures. ``bars``, the arbitrage series, is read once, into states per minute; the rest is rolled up from them."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import measures as m
from tickloom.functions import spreads as sp
from tickloom.functions.timeexpr import bucket_s, day_of_s, month_of_day, month_of_s
from tickloom.operators import moments
from tickloom.operators.cleaning import PRICE_RANGES, day_rules, range_rules
from tickloom.operators.descriptive import describe
from tickloom.operators.rates import PairRates, join_base_rate, join_quote_rate, join_rate
from tickloom.session import stage
from tickloom.sources.schemas import MONTHLY_MEASURES

KEY = ["year_month", "symbol"]
MINUTES_PER_MONTH = 60 * 24 * 30


def minute_returns(bars: DataFrame, keep: Column, price: str = "avg_price", seconds: int = 60) -> DataFrame:
    """Logarithmic return within each minute (or other interval), without returns of a half or more."""
    second = F.unix_seconds("start_second")
    return (
        bars.where(keep & ~F.isnan(price))
        .select(second.alias("second"), bucket_s(second, seconds).alias("start_minute"), "symbol", price)
        .groupBy("start_minute", "symbol")
        .agg(m.log_return(F.col(price), F.col("second")).alias("return"))
        .where(sp.clipped_return())
    )


def monthly_volatility(returns: DataFrame, prefix: str = "") -> DataFrame:
    name = f"{prefix}volatility_minute_returns"
    return (
        returns.groupBy(month_of_s(F.col("start_minute")).alias("year_month"), "symbol")
        .agg(F.stddev_samp("return").alias(name))
        .withColumn(f"{name}_monthly", F.lit(sqrt(MINUTES_PER_MONTH)) * F.col(name))
    )


def minute_states(bars: DataFrame, keep: Column, seconds: int = 60) -> DataFrame:
    """Everything the monthly tables need of ``bars``, per minute (or other interval) and symbol, from one scan: staged.

    Of rows that pass ``keep`` and have a price: the state of the price, positive spreads, trades, profit and the
    logarithmic return; of all rows: profit and volume. Intervals end at midnight, so they add up to days and months.
    """
    second, known = F.unix_seconds("start_second"), keep & sp.price_is_known()
    bips = F.when(known, sp.spread_as_midpoint_bips())
    positive = F.when(m.is_positive(bips), bips)
    time = F.when(known, second)
    states = bars.groupBy(bucket_s(second, seconds).alias("start_minute"), "symbol").agg(
        *moments.state(F.col("avg_price"), "avg_price", known),
        F.sum(positive).alias("bips"),
        F.count(positive).alias("bips_positive"),
        F.sum(F.when(known, F.col("total_number_of_trades"))).alias("total_number_of_trades"),
        F.sum(F.when(known, F.col("arbitrage_profit"))).alias("known_profit"),
        m.log_return(F.col("avg_price"), time).alias("return"),
        F.sum("arbitrage_profit").alias("arbitrage_profit"),
        F.sum("total_volume").alias("total_volume"),
    )
    return stage(states, "minute-states")


def _daily(states: DataFrame) -> DataFrame:
    return states.groupBy(day_of_s(F.col("start_minute")).alias("day"), "symbol").agg(
        F.sum("arbitrage_profit").alias("daily_arbitrage_profit"), F.sum("total_volume").alias("daily_total_volume")
    )


def _returns(states: DataFrame) -> DataFrame:
    return states.where(sp.clipped_return())


def _spread_measures(states: DataFrame) -> DataFrame:
    """Spreads, trades and prices of the months that hold a row with a known price."""
    known = states.where("avg_price_rows > 0").withColumn("year_month", month_of_s(F.col("start_minute")))
    centered = known.join(moments.centers(known, KEY, ["avg_price"]), KEY)
    return (
        centered.groupBy(*KEY)
        .agg(
            *moments.merged("avg_price"),
            F.coalesce(F.try_divide(F.sum("bips"), F.sum("bips_positive")), F.lit(0.0)).alias("average_arbitrage_spread_bips"),
            F.sum("bips_positive").alias("number_of_seconds_arbitrage_spread_positive"),
            F.sum("total_number_of_trades").alias("total_number_of_trades"),
            F.sum("known_profit").alias("known_profit"),
        )
        .withColumn("avg_price", F.col("avg_price_mean"))
        .withColumn("stddev_price", moments.sample_deviation("avg_price"))
        .withColumn("ratio_stddev_avg_price", F.try_divide("stddev_price", "avg_price"))
    )


def daily_profit_and_volume(states: DataFrame, rates: DataFrame, pairs: list[PairRates]) -> DataFrame:
    """Days are summed before any rate is joined."""
    return (
        join_base_rate(join_quote_rate(_daily(states), rates, pairs), rates, pairs)
        .withColumn(
            "daily_arbitrage_profit_in_usd", sp.in_usd("daily_arbitrage_profit", "usd_rate_average_daily_price")
        )
        .withColumn(
            "daily_total_volume_in_usd", sp.in_usd("daily_total_volume", "usd_rate_base_ccy_average_daily_price")
        )
    )


def pair_states(bars: DataFrame, return_seconds: int = 60) -> DataFrame:
    """:func:`minute_states` under the rules of pairs quoted in any currency."""
    return minute_states(bars, day_rules(), return_seconds)


def usd_pair_states(bars: DataFrame, return_seconds: int = 60) -> DataFrame:
    """:func:`minute_states` of dollar pairs under their rules."""
    return minute_states(bars.where(F.col("symbol").endswith("usd")), range_rules(PRICE_RANGES), return_seconds)


def measures_of(states: DataFrame, rates: DataFrame, pairs: list[PairRates]) -> DataFrame:
    """Spread, profit, volume and volatility by month from :func:`pair_states`."""
    profit = (
        daily_profit_and_volume(states, rates, pairs)
        .groupBy(month_of_day(F.col("day")).alias("year_month"), "symbol")
        .agg(
            F.sum("daily_arbitrage_profit_in_usd").alias("arbitrage_profit_in_usd"),
            F.avg("usd_rate_average_daily_price").alias("usd_rate_average_price"),
            F.sum("daily_total_volume_in_usd").alias("total_volume_in_usd"),
        )
    )
    return (
        _spread_measures(states).join(profit, KEY).join(monthly_volatility(_returns(states)), KEY).select(*MONTHLY_MEASURES.names)
    )


def monthly_measures(
    bars: DataFrame, rates: DataFrame, pairs: list[PairRates], return_seconds: int = 60
) -> DataFrame:
    """Spread, profit, volume and volatility by month, for pairs quoted in any currency. ``bars`` is read once."""
    return measures_of(pair_states(bars, return_seconds), rates, pairs)


def daily_volume_own_rate(states: DataFrame, rates: DataFrame) -> DataFrame:
    return join_rate(_daily(states), rates, F.col("symbol"), "usd_rate").withColumn(
        "daily_total_volume_in_usd", sp.in_usd("daily_total_volume", "usd_rate_average_daily_price")
    )


def usd_measures_of(states: DataFrame, rates: DataFrame) -> DataFrame:
    """As :func:`measures_of` from :func:`usd_pair_states`: profit is in dollars already, volume converts at the pair's
    own daily price, and the month's rate is the mean of the rate table."""
    volume = (
        daily_volume_own_rate(states, rates)
        .groupBy(month_of_day(F.col("day")).alias("year_month"), "symbol")
        .agg(F.sum("daily_total_volume_in_usd").alias("total_volume_in_usd"))
    )
    monthly_rate = rates.groupBy(month_of_day(F.col("day")).alias("year_month"), "symbol").agg(
        F.avg("average_daily_price").alias("usd_rate_average_price")
    )
    return (
        _spread_measures(states)
        .withColumnRenamed("known_profit", "arbitrage_profit_in_usd")
        .join(monthly_rate, KEY)
        .join(volume, KEY)
        .join(monthly_volatility(_returns(states)), KEY)
        .select(*MONTHLY_MEASURES.names)
    )


def monthly_measures_usd_pair(bars: DataFrame, rates: DataFrame, return_seconds: int = 60) -> DataFrame:
    """As :func:`monthly_measures` for dollar pairs."""
    return usd_measures_of(usd_pair_states(bars, return_seconds), rates)


def statistics_of(states: DataFrame, daily: DataFrame) -> DataFrame:
    """Statistics of bar price, daily dollar volume and minute return that accompany the monthly measures."""
    return (
        moments.statistics(moments.merge(states.where("avg_price_rows > 0"), ["symbol"], ["avg_price"]), ["avg_price"])
        .unionByName(describe(daily, ["daily_total_volume_in_usd"]))
        .unionByName(describe(_returns(states), ["return"]))
    )


def monthly_statistics(
    bars: DataFrame, rates: DataFrame, pairs: list[PairRates], return_seconds: int = 60
) -> DataFrame:
    states = pair_states(bars, return_seconds)
    return statistics_of(states, daily_profit_and_volume(states, rates, pairs))


def monthly_statistics_usd_pair(bars: DataFrame, rates: DataFrame, return_seconds: int = 60) -> DataFrame:
    states = usd_pair_states(bars, return_seconds)
    return statistics_of(states, daily_volume_own_rate(states, rates))


def combine_monthly(measures: DataFrame, volatility: DataFrame) -> DataFrame:
    """All runs' monthly measures with the monthly volatility where there is one."""
    return measures.join(volatility, ["year_month", "symbol"], "left")
