"""Triangular arbitrage between crypto-stable, crypto-dollar and stable-dollar pairs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.measures import is_positive

LEGS = ["crypto_stable", "crypto_usd", "stable_usd"]


class Triangle(NamedTuple):
    crypto_stable: str
    crypto_usd: str
    stable_usd: str

    @property
    def symbol(self) -> str:
        return f"{self.crypto_stable}-{self.crypto_usd}-{self.stable_usd}"


def triangle_legs(df: DataFrame, triangles: list[Triangle]) -> DataFrame:
    """The literal (leg symbol, triangle, leg) table: three rows per requested triangle."""
    rows = [(getattr(t, leg), t.symbol, leg) for t in triangles for leg in LEGS]
    return df.sparkSession.createDataFrame(rows, "symbol string, triangle string, leg string")


def leg_rows(bars: DataFrame, triangles: list[Triangle]) -> DataFrame:
    """Bars tagged with every triangle they are a leg of; all other symbols drop out.

    The broadcast side is the literal triangle list, three short rows each, whatever the data size.
    """
    wanted = sorted({leg for t in triangles for leg in t})
    legs = F.broadcast(triangle_legs(bars, triangles))
    return bars.where(F.col("symbol").isin(*wanted)).join(legs, "symbol")


def _leg(column: str, leg: str) -> Column:
    return F.max(F.when(F.col("leg") == leg, F.coalesce(F.col(column), F.lit(0.0))))


def _spread(crypto_stable: Column, crypto_usd: Column, stable_usd: Column, sell: bool) -> Column:
    known = (crypto_stable != 0) & (crypto_usd != 0) & (stable_usd != 0)
    implied = F.try_divide(crypto_usd, crypto_stable)
    gap = implied - stable_usd if sell else stable_usd - implied
    return F.when(known & is_positive(gap), gap).otherwise(F.lit(0.0))


def _volume(crypto_stable: Column, crypto_usd: Column, stable_usd: Column, price: Column) -> Column:
    known = (crypto_stable != 0) & (crypto_usd != 0) & (stable_usd != 0) & (price != 0)
    return F.when(known, F.least(crypto_stable * price, crypto_usd * price, stable_usd)).otherwise(F.lit(0.0))


def triangulate(bars: DataFrame, triangles: list[Triangle]) -> DataFrame:
    """Per bar and triangle: leg prices, sell and buy spreads, executable volumes and profits.

    Selling the stable coin compares the implied stable price, crypto-usd bid over crypto-stable
    ask, with the direct ask; buying compares the direct bid with crypto-usd ask over crypto-stable
    bid. Everything is 0 unless all three legs traded.
    """
    ask, bid = "min_price_trades_ask", "max_price_trades_bid"
    ask_volume, bid_volume = "volume_of_min_price_trades_ask", "volume_of_max_price_trades_bid"
    columns = ["avg_price", ask, bid, ask_volume, bid_volume, "total_volume"]
    legs = leg_rows(bars, triangles)
    wide = legs.groupBy("start_second", "triangle").agg(
        *[_leg(column, leg).alias(f"{leg}__{column}") for leg in LEGS for column in columns]
    )

    def pick(*names: str) -> list[Column]:
        return [F.col(f"{leg}__{name}") for leg, name in zip(LEGS, names)]

    price = F.col("crypto_stable__avg_price")
    return (
        wide.select(
            "start_second",
            F.col("triangle").alias("symbol"),
            *[F.coalesce(F.col(f"{leg}__avg_price"), F.lit(0.0)).alias(f"avg_{leg}_price") for leg in LEGS],
            _spread(*pick(ask, bid, ask), sell=True).alias("sell_arbitrage_spread"),
            _spread(*pick(bid, ask, bid), sell=False).alias("buy_arbitrage_spread"),
            _volume(*pick(ask_volume, bid_volume, ask_volume), price).alias("sell_volume"),
            _volume(*pick(bid_volume, ask_volume, bid_volume), price).alias("buy_volume"),
            _volume(*pick("total_volume", "total_volume", "total_volume"), price).alias("total_volume"),
        )
        .withColumn("sell_arbitrage_profit", F.col("sell_arbitrage_spread") * F.col("sell_volume"))
        .withColumn("buy_arbitrage_profit", F.col("buy_arbitrage_spread") * F.col("buy_volume"))
    )
