"""Explicit schemas of every table; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

TRADES = _table(
    ("id", _S), ("exchange", _S), ("symbol", _S), ("date", _L), ("price", _D), ("amount", _D), ("sell", _B),
)

ORDER_BOOK = _table(("date", _L), ("type", _S), ("price", _D), ("amount", _D))

ARBITRAGE = _table(
    ("start_second", _TS), ("symbol", _S), ("total_number_of_trades", _L), ("avg_price", _D), ("total_volume", _D),
    ("min_price_trades_ask", _D), ("exchange_of_min_price_trades_ask", _S),
    ("order_flow_of_min_price_trades_ask", _D), ("volume_of_min_price_trades_ask", _D),
    ("max_price_trades_bid", _D), ("exchange_of_max_price_trades_bid", _S),
    ("order_flow_of_max_price_trades_bid", _D), ("volume_of_max_price_trades_bid", _D),
    ("total_order_flow", _D), ("arbitrage_spread", _D), ("arbitrage_profit", _D),
)

DAILY_PRICE = _table(
    ("day", _S), ("symbol", _S), ("number_of_trades", _L), ("total_amount", _D), ("average_daily_price", _D),
)

PARITY_RATE = _table(("day", _S), ("symbol", _S), ("average_daily_price", _D))

TIME_GRID = _table(("start", _L), ("start_display", _S))

BOOK_SERIES = _table(
    ("start_ts_ob", _L), ("symbol", _S), ("bid_ask_spread", _D), ("midpoint_ob", _D),
    ("liquidity_imbalance_1avg", _D), ("liquidity_imbalance_2avg", _D), ("liquidity_imbalance_3avg", _D),
    ("return", _D), ("logreturn", _D), ("total_number_of_trades", _D), ("total_volume", _D), ("avg_price", _D),
    ("price_parity", _D), ("avg_trade_size", _D), ("avg_arbitrage_spread", _D), ("avg_arbitrage_profit", _D),
    ("avg_arbitrage_spread_as_midpoint_bips", _D), ("total_order_flow", _D), ("effective_spread_ob", _D),
    ("date_display", _S),
)

CLEAN_SERIES = T.StructType(
    BOOK_SERIES.fields
    + _table(
        ("bid_ask_spread_bps", _D), ("day", _S), ("usd_rate", _S), ("usd_rate_average_daily_price", _D),
        ("total_order_flow_usd", _D),
    ).fields
)

STATISTICS = _table(
    ("mean", _D), ("stddev", _D), ("skewness", _D), ("kurtosis", _D), ("min", _D), ("max", _D),
    ("percentage_of_zeros", _D), ("variation_coefficient", _D), ("type", _S), ("symbol", _S),
)

INTRA_CORRELATIONS = _table(
    ("symbol", _S), ("first", _S), ("second", _S), ("correlation", _D), ("significance", _D),
)

CROSS_CORRELATIONS = _table(
    ("measure", _S), ("first", _S), ("second", _S), ("correlation", _D), ("significance", _D),
)

MONTHLY_MEASURES = _table(
    ("year_month", _S), ("symbol", _S), ("average_arbitrage_spread_bips", _D),
    ("number_of_seconds_arbitrage_spread_positive", _L), ("total_number_of_trades", _L), ("avg_price", _D),
    ("stddev_price", _D), ("ratio_stddev_avg_price", _D), ("arbitrage_profit_in_usd", _D),
    ("usd_rate_average_price", _D), ("total_volume_in_usd", _D), ("volatility_minute_returns", _D),
    ("volatility_minute_returns_monthly", _D),
)

MONTHLY_VOLATILITY = _table(
    ("year_month", _S), ("symbol", _S), ("monthly_volatility_logreturns", _D),
    ("annualized_monthly_volatility_logreturns", _D),
)

TRIANGLE_MONTHLY = _table(
    ("year_month", _S), ("symbol", _S), ("sell_arbitrage_profit_in_usd", _D), ("buy_arbitrage_profit_in_usd", _D),
    ("average_sell_arbitrage_spread_bips", _D), ("average_buy_arbitrage_spread_bips", _D),
    ("number_of_seconds_sell_arbitrage_spread_positive", _L), ("number_of_seconds_buy_arbitrage_spread_positive", _L),
    ("total_volume_in_usd", _D), ("avg_price", _D), ("stddev_price", _D), ("ratio_stddev_avg_price", _D),
    ("volatility_minute_returns", _D), ("volatility_minute_returns_monthly", _D),
)

INTRADAY_BREAKDOWN = _table(
    ("start_minute_of_day", _L), ("symbol", _S), ("avg_total_volume_in_usd_as_daily_percentage", _D),
    ("avg_total_number_of_trades_as_daily_percentage", _D), ("avg_arbitrage_profit_in_usd_as_daily_percentage", _D),
    ("total_number_of_trades", _D), ("total_volume_in_usd", _D), ("total_order_flow_in_usd", _D),
    ("arbitrage_profit_in_usd", _D), ("avg_arbitrage_spread_as_midpoint_bips", _D), ("avg_price_parity", _D),
)
