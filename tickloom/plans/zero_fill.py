"""Zero-filled return series, their statistics and realized volatility."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import measures as m
from tickloom.functions import spreads as sp
from tickloom.functions.timeexpr import DAY_MS, bucket_ms, bucket_s_to_ms, day_arg_to_ms, day_of_ms, month_of_day, month_of_ms, raster_cells
from tickloom.operators import moments
from tickloom.operators.cleaning import PRICE_RANGES, day_rules, outlier_filter, range_rules
from tickloom.operators.descriptive import describe
from tickloom.operators.grid import fill_with_symbol_mean, in_period, on_grid, zero_fill

FILLED = ["return", "logreturn", "total_number_of_trades"]
ANNUALIZED = "annualized_daily_volatility_logreturns"


def cleaned_bars(bars: DataFrame, seconds: int) -> DataFrame:
    """Bars with known, plausible prices within three deviations of their bucket."""
    second = F.unix_seconds("start_second")
    known = bars.where(sp.price_is_known() & day_rules() & range_rules(PRICE_RANGES))
    bucketed = known.withColumn("second", second).withColumn("start_ts", bucket_s_to_ms(second, seconds))
    return outlier_filter(bucketed, ["symbol", "start_ts"], "avg_price", bounded=True)


def return_series(bars: DataFrame, seconds: int) -> DataFrame:
    """Per bucket: returns, trade count and mean price.

    As in every series here, column ``return`` is the logarithmic return and ``logreturn`` the
    simple one; the names are kept for compatibility with existing result files.
    """
    price, time = F.col("avg_price"), F.col("second")
    return (
        cleaned_bars(bars, seconds)
        .groupBy("start_ts", "symbol")
        .agg(
            m.log_return(price, time).alias("return"),
            m.simple_return(price, time).alias("logreturn"),
            F.sum("total_number_of_trades").cast("double").alias("total_number_of_trades"),
            F.avg("avg_price").alias("avg_price"),
        )
    )


def zero_filled_series(series: DataFrame, first_day: str, end_day: str, seconds: int) -> DataFrame:
    """``series`` (read twice) on the full grid: no trades means no return; the price is the symbol's mean.

    Rows outside the period count nowhere; take ``in_period`` of the series before describing it beside this.
    """
    series = in_period(series, "start_ts", day_arg_to_ms(first_day), day_arg_to_ms(end_day))
    grid = on_grid(series, "start_ts", day_arg_to_ms(first_day), day_arg_to_ms(end_day), seconds * 1000)
    return fill_with_symbol_mean(zero_fill(grid, FILLED), "avg_price", series)


def daily_volatility(filled: DataFrame) -> DataFrame:
    return (
        filled.groupBy(day_of_ms(F.col("start")).alias("day"), "symbol")
        .agg(m.realized_volatility(F.col("logreturn")).alias("daily_volatility_logreturns"))
        .withColumn("annualized_daily_volatility_logreturns", F.lit(sqrt(365)) * F.col("daily_volatility_logreturns"))
    )


def monthly_volatility(filled: DataFrame) -> DataFrame:
    return (
        filled.groupBy(month_of_ms(F.col("start")).alias("year_month"), "symbol")
        .agg(m.realized_volatility(F.col("logreturn")).alias("monthly_volatility_logreturns"))
        .withColumn(
            "annualized_monthly_volatility_logreturns", F.lit(sqrt(12)) * F.col("monthly_volatility_logreturns")
        )
    )


# The same figures from the rows there are: an empty cell of the grid adds a zero, so it need not be made ------------------


def present_rows(series: DataFrame, first_day: str, end_day: str, seconds: int) -> DataFrame:
    """Rows of ``series`` that the grid of the period would hold, with 0 for null and NaN returns and counts."""
    inside = in_period(series, "start_ts", day_arg_to_ms(first_day), day_arg_to_ms(end_day))
    return zero_fill(inside.where(F.col("start_ts") == bucket_ms(F.col("start_ts"), seconds)), FILLED)


def daily_squares(present: DataFrame) -> DataFrame:
    """Sum of squared returns of every day that has a row."""
    return present.groupBy(day_of_ms(F.col("start_ts")).alias("day"), "symbol").agg(
        m.realized_variance(F.col("logreturn")).alias("variance")
    )


def sparse_statistics(series: DataFrame, first_day: str, end_day: str, seconds: int) -> DataFrame:
    """The statistics of :func:`zero_filled_statistics` for the series and its zero-filled grid, without the grid.

    ``series`` is read twice; pass a table.
    """
    first, end = day_arg_to_ms(first_day), day_arg_to_ms(end_day)
    present = present_rows(series, first_day, end_day, seconds)
    states = present.groupBy("symbol").agg(
        *moments.state(F.col("avg_price"), "avg_price"), *[c for name in FILLED for c in moments.state(F.col(name), name)]
    )
    for name in FILLED:
        states = moments.with_zeros(states, name, F.lit(raster_cells(first, end, seconds * 1000)))
    days = daily_squares(present).withColumn(ANNUALIZED, F.lit(sqrt(365)) * F.sqrt("variance"))
    daily = days.groupBy("symbol").agg(*moments.state(F.col(ANNUALIZED), ANNUALIZED))
    daily = moments.with_zeros(daily, ANNUALIZED, F.lit(raster_cells(first, end, DAY_MS)))
    return moments.statistics(states, ["avg_price", *FILLED]).unionByName(moments.statistics(daily, [ANNUALIZED]))


def sparse_monthly_volatility(series: DataFrame, first_day: str, end_day: str, seconds: int) -> DataFrame:
    """:func:`monthly_volatility` of the zero-filled series, without the grid: months without a row have none.

    ``series`` is read twice; pass a table.
    """
    first, end = day_arg_to_ms(first_day), day_arg_to_ms(end_day)
    present = present_rows(series, first_day, end_day, seconds)
    starts = F.sequence(F.lit(first), F.lit(max(end - 1, first)), F.lit(DAY_MS))
    months = F.explode(F.array_distinct(F.transform(starts, month_of_ms))).alias("year_month")
    every = present.select("symbol").distinct().select("symbol", months)  # symbols times months
    squares = daily_squares(present).groupBy(month_of_day(F.col("day")).alias("year_month"), "symbol").agg(F.sum("variance").alias("variance"))
    volatility = F.sqrt(F.coalesce("variance", F.lit(0.0)))
    return every.join(squares, ["year_month", "symbol"], "left").select(
        "year_month", "symbol", volatility.alias("monthly_volatility_logreturns"),
        (F.lit(sqrt(12)) * volatility).alias("annualized_monthly_volatility_logreturns"),
    )


def zero_filled_statistics(series: DataFrame, filled: DataFrame) -> DataFrame:
    """Statistics of a series and of its filled grid, where that is at hand; else see :func:`sparse_statistics`."""
    return (
        describe(series, ["avg_price"])
        .unionByName(describe(filled, FILLED))
        .unionByName(describe(daily_volatility(filled), ["annualized_daily_volatility_logreturns"]))
    )
