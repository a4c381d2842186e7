"""Row-level price and spread expressions over the arbitrage and order-book series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.measures import is_positive

BIPS = 10_000.0


def prices_not_nan(ask: str = "min_price_trades_ask", bid: str = "max_price_trades_bid") -> Column:
    return ~F.isnan(ask) & ~F.isnan(bid)


def exchanges_differ() -> Column:
    return F.col("exchange_of_min_price_trades_ask") != F.col("exchange_of_max_price_trades_bid")


def arbitrage_spread() -> Column:
    """Best bid less best ask when they come from two exchanges and the gap is positive, else 0."""
    gap = F.col("max_price_trades_bid") - F.col("min_price_trades_ask")
    return F.when(prices_not_nan() & exchanges_differ() & is_positive(gap), gap).otherwise(F.lit(0.0))


def arbitrage_profit() -> Column:
    executable = F.least("volume_of_min_price_trades_ask", "volume_of_max_price_trades_bid")
    return F.col("arbitrage_spread") * executable


def spread_as_midpoint_bips() -> Column:
    spread = F.col("arbitrage_spread")
    midpoint = 0.5 * (F.col("min_price_trades_ask") + F.col("max_price_trades_bid"))
    return F.when(is_positive(spread), F.try_divide(F.lit(BIPS) * spread, midpoint)).otherwise(F.lit(0.0))


def price_parity() -> Column:
    return F.col("avg_price") - 1.0


def price_is_known() -> Column:
    return ~F.isnan("avg_price")


def effective_spread() -> Column:
    return 2.0 * F.abs(F.col("avg_price") - F.col("midpoint_ob"))


def as_bps(spread: str, midpoint: str = "midpoint_ob") -> Column:
    return F.try_divide(F.col(spread), F.col(midpoint)) * BIPS


def in_usd(column: str, rate: str) -> Column:
    """Dollar value of an amount; without a rate the currency counts as one dollar a unit."""
    return F.col(column) * F.coalesce(F.col(rate), F.lit(1.0))


def share_of(value: Column, total: Column) -> Column:
    """Part of a total. Over a total of 0, or none, the value stands as it is."""
    return F.when(total.isNotNull() & (total != 0), value.cast("double") / total.cast("double")).otherwise(
        value.cast("double")
    )


def clipped_return(column: str = "return", limit: float = 0.5) -> Column:
    return (F.col(column) > -limit) & (F.col(column) < limit)
