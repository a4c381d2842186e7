"""Triangular arbitrage series and its monthly measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import measures as m
from tickloom.functions import spreads as sp
from tickloom.functions.timeexpr import month_of_ts
from tickloom.operators.triangle import Triangle, triangulate
from tickloom.plans.monthly import minute_returns, monthly_volatility
from tickloom.sources.schemas import TRIANGLE_MONTHLY


def triangulation(bars: DataFrame, triangles: list[Triangle]) -> DataFrame:
    """Sell and buy arbitrage of each triangle per bar, with spreads also in bips of the stable coin's price."""
    def bips(side: str):
        spread = F.col(f"{side}_arbitrage_spread")
        return F.when(
            m.is_positive(spread), F.try_divide(F.lit(sp.BIPS) * spread, F.col("avg_stable_usd_price"))
        ).otherwise(F.lit(0.0))

    return (
        triangulate(bars, triangles)
        .withColumn("sell_arbitrage_spread_bips", bips("sell"))
        .withColumn("buy_arbitrage_spread_bips", bips("buy"))
    )


def triangulation_monthly(series: DataFrame, return_seconds: int = 60) -> DataFrame:
    """Monthly measures per triangle. Prices and volatility are those of the stable coin in dollars."""
    price = F.col("avg_stable_usd_price")
    known = m.is_positive(price)
    rate = F.when(known, price).otherwise(F.lit(1.0))
    measures = (
        series.withColumn("year_month", month_of_ts(F.col("start_second")))
        .groupBy("year_month", "symbol")
        .agg(
            *[F.sum(f"{s}_arbitrage_profit").alias(f"{s}_arbitrage_profit_in_usd") for s in ("sell", "buy")],
            *[
                m.avg_if_positive(F.col(f"{s}_arbitrage_spread_bips")).alias(f"average_{s}_arbitrage_spread_bips")
                for s in ("sell", "buy")
            ],
            *[
                m.count_if_positive(F.col(f"{s}_arbitrage_spread_bips")).alias(
                    f"number_of_seconds_{s}_arbitrage_spread_positive"
                )
                for s in ("sell", "buy")
            ],
            F.sum(F.col("total_volume") * rate).alias("total_volume_in_usd"),
            F.avg(F.when(known, price)).alias("avg_price"),
            F.stddev_samp(F.when(known, price)).alias("stddev_price"),
        )
        .withColumn("ratio_stddev_avg_price", F.try_divide("stddev_price", "avg_price"))
    )
    returns = minute_returns(series, known, "avg_stable_usd_price", return_seconds)
    joined = measures.join(monthly_volatility(returns), ["year_month", "symbol"], "left")
    return joined.select(*TRIANGLE_MONTHLY.names)
