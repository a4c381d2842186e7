"""Bars and daily prices from raw trades."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickloom.functions.timeexpr import day_arg_to_ms
from tickloom.operators.bars import cross_exchange_bars, daily_prices, exchange_bars, in_range


def _within(trades: DataFrame, first_day: str | None, last_day: str | None) -> DataFrame:
    if first_day is None or last_day is None:
        return trades
    return in_range(trades, day_arg_to_ms(first_day), day_arg_to_ms(last_day))


def trades_arbitrage(
    trades: DataFrame, seconds: int, first_day: str | None = None, last_day: str | None = None,
    nan_policy: str = "propagate",
) -> DataFrame:
    """Cross-exchange arbitrage series for every symbol in ``trades``."""
    return cross_exchange_bars(exchange_bars(_within(trades, first_day, last_day), seconds), nan_policy)


def daily_average_price(trades: DataFrame, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Daily volume-weighted price, the source of the USD rates."""
    return daily_prices(_within(trades, first_day, last_day))
