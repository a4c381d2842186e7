"""Report tables over finished results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.measures import aggregate_by_name
from tickloom.operators.cleaning import replace_outliers
from tickloom.operators.sampling import stride_sample

# Trading fee per leg, the reports' pair order, stable coins traded in dollars,
# measures left out of single-pair matrices, and the quantities that get a statistics report.
FEE = 0.001
BPS = 0.0001
MAIN_PAIRS = ["btcusdt", "ethusdt", "ethbtc", "btcusd", "ethusd", "usdtusd"]
STABLE_USD_PAIRS = ["daiusd", "paxusd", "tusdusd", "usdcusd", "usdtusd"]
OMITTED_MEASURES = ["avg_arbitrage_spread", "effective_spread_ob"]
STATISTICS_TYPES = [
    "avg_price", "return", "total_number_of_trades", "daily_total_volume_in_usd",
    "annualized_daily_volatility_logreturns", "logreturn", "bid_ask_spread", "effective_spread_ob",
    "total_order_flow", "avg_arbitrage_spread_as_midpoint_bips", "bid_ask_spread_bps", "total_order_flow_usd",
]
# Report column -> factor.
SINGLE_PAIR_TABLES = {
    "arbitrage_profit_in_usd": 1.0,
    "average_arbitrage_spread_bips": 1.0,
    "number_of_seconds_arbitrage_spread_positive": 1.0,
    "total_volume_in_usd": 1e-6,
    "ratio_stddev_avg_price": 100.0,
    "volatility_minute_returns_monthly": 100.0,
    "total_number_of_trades": 1e-3,
    "annualized_monthly_volatility_logreturns": 100.0,
}
TRIANGLE_TABLES = {
    "sell_arbitrage_profit_in_usd": 1.0,
    "average_sell_arbitrage_spread_bips": 1.0,
    "number_of_seconds_sell_arbitrage_spread_positive": 1.0,
    "buy_arbitrage_profit_in_usd": 1.0,
    "average_buy_arbitrage_spread_bips": 1.0,
    "number_of_seconds_buy_arbitrage_spread_positive": 1.0,
    "total_volume_in_usd": 1e-3,
    "ratio_stddev_avg_price": 100.0,
    "volatility_minute_returns_monthly": 100.0,
}


def monthly_pivot(monthly: DataFrame, column: str, months: list[str] | None = None, factor: float = 1.0) -> DataFrame:
    """Symbol x month table of one column, for the given months or all; two rows for one cell fail the query."""
    value = F.col(column).cast("double")
    cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("more than one row for a symbol and month")).cast("double"))
    return monthly.groupBy("symbol").pivot("year_month", months).agg(
        F.coalesce(cell, F.max(value)) * F.lit(float(factor))
    )


def month_range(monthly: DataFrame, month: str = "year_month") -> list[str]:
    """All months from the table's first to its last, from those two values alone."""
    first, last = monthly.agg(F.min(month), F.max(month)).first()
    if first is None:
        return []
    at, out = first, []
    while at <= last:
        out.append(at)
        year, number = divmod(int(at[:4]) * 12 + int(at[5:7]), 12)
        at = f"{year:04d}-{number + 1:02d}"
    return out


def arbitrage_summary(monthly: DataFrame, side: str = "") -> DataFrame:
    """Totals over the months, spread weighted by the number of opportunities, and profit net of fees.

    ``side`` is empty for single pairs, ``sell`` or ``buy`` for triangles. A month enters the
    weighted spread only when both spread and count are known.
    """
    infix = f"{side}_" if side else ""
    profit = F.col(f"{infix}arbitrage_profit_in_usd")
    count = F.col(f"number_of_seconds_{infix}arbitrage_spread_positive")
    spread = F.col(f"average_{infix}arbitrage_spread_bips")
    both = spread.isNotNull() & count.isNotNull()
    gross = F.try_divide(F.col("profits"), F.col("spread") * BPS)
    margin = F.greatest(F.lit(0.0), F.col("spread") * BPS - 2 * FEE)
    return (
        monthly.groupBy("symbol")
        .agg(
            F.coalesce(F.sum(profit), F.lit(0.0)).alias("profits"),
            F.coalesce(F.sum(count), F.lit(0)).alias("opportunities"),
            F.try_divide(F.sum(F.when(both, spread * count)), F.sum(F.when(both, count))).alias("spread"),
        )
        .withColumn("net_profits", gross * margin)
    )


def statistics_report(statistics: DataFrame, order: list[str] = MAIN_PAIRS) -> DataFrame:
    """One row per (type, symbol) of the reported types and symbols, with the row's place in the report.

    Of duplicated (symbol, type) rows the one with the smallest values is taken. The share of zeros
    is reported for trade counts only.
    """
    values = [c for c in statistics.columns if c not in ("symbol", "type")]
    distinct = (
        statistics.where(F.col("type").isin(*STATISTICS_TYPES) & F.col("symbol").isin(*order))
        .groupBy("type", "symbol")
        .agg(F.min(F.struct(*values)).alias("row"))
        .select("type", "symbol", "row.*")
    )
    zeros = F.when(F.col("type") == "total_number_of_trades", F.col("percentage_of_zeros"))
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("symbol"))
    return distinct.withColumn("percentage_of_zeros", zeros).withColumn("position", place)


def parity_table(breakdown: DataFrame) -> DataFrame:
    parity = F.col("avg_price_parity")
    return breakdown.groupBy("symbol").agg(
        F.min(parity).alias("min"), F.max(parity).alias("max"), F.stddev_samp(parity).alias("stdev")
    )


def _cells(correlations: DataFrame, keys: list[str], row: str, column: str) -> DataFrame:
    return correlations.select(
        *keys, F.col(row).alias("entity"), F.col(column).alias("other"), "correlation", "significance"
    )


def correlation_matrix(
    upper: DataFrame,
    lower: DataFrame,
    entities: list[str],
    keys: list[str],
    threshold: float | None = None,
    significance_threshold: float | None = None,
) -> DataFrame:
    """Two-frequency matrix in long form: ``upper`` fills the cells above the diagonal, ``lower`` those below.

    Weak correlations (below ``threshold``) and insignificant p-values become null. The cross-pair
    report puts 5 minutes above and 60 below, the single-pair report the other way round.
    """
    def triangle(source: DataFrame, above: bool) -> DataFrame:
        known = source.where(F.col("first").isin(*entities) & F.col("second").isin(*entities))
        smaller, larger = F.least("first", "second"), F.greatest("first", "second")
        sorted_pairs = known.withColumn("_a", smaller).withColumn("_b", larger)
        return _cells(sorted_pairs, keys, "_a" if above else "_b", "_b" if above else "_a")

    off_diagonal = triangle(upper, True).unionByName(triangle(lower, False))
    diagonal = (
        triangle(upper, True).select(*keys).distinct()
        .withColumn("entity", F.explode(F.array(*[F.lit(e) for e in entities])))
        .withColumn("other", F.col("entity"))
        .withColumn("correlation", F.lit(1.0))
        .withColumn("significance", F.lit(0.0))
    )
    strong, significant = F.col("correlation"), F.col("significance")
    if threshold:
        strong = F.when(F.abs(strong) >= threshold, strong)
    if significance_threshold:
        significant = F.when(significant < significance_threshold, significant)
    masked = off_diagonal.withColumn("correlation", strong).withColumn("significance", significant)
    return masked.unionByName(diagonal)


def matrix_table(matrix: DataFrame, keys: list[str], entities: list[str], value: str = "correlation") -> DataFrame:
    """Long matrix to one column per entity."""
    return matrix.groupBy(*keys, "entity").pivot("other", entities).agg(F.first(value))


def plot_series(bars: DataFrame, column: str, aggregate: str | None, samples: int | None) -> DataFrame:
    """Points to plot per symbol: by day with the chosen aggregate (or bar by bar), stride-sampled."""
    if not aggregate:
        points = bars.select("symbol", F.col("start_second").alias("x"), F.col(column).alias("y"))
        return stride_sample(points, "x", samples)
    days = bars.groupBy("symbol", F.date_trunc("day", "start_second").alias("x")).agg(
        aggregate_by_name(aggregate, column).alias("y")
    )
    return stride_sample(days, "x", samples, day="x")


def breakdown_points(breakdown: DataFrame, measures: list[str]) -> DataFrame:
    """Long (symbol, hour, measure, value) table of an intraday breakdown."""
    points = F.inline(
        F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in measures])
    )
    return breakdown.select("symbol", (F.col("start_minute_of_day") / 60.0).alias("hour"), points)


def clipped_parity(breakdown: DataFrame, symbols: list[str] = STABLE_USD_PAIRS) -> DataFrame:
    """Price parity of stable coins with its outliers set to the mean."""
    return replace_outliers(breakdown, "symbol", "avg_price_parity", symbols)
