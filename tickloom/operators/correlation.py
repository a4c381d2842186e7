"""Pearson correlations with significance, from grouped moments."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.significance import correlation_t, p_value
from tickloom.functions.timeexpr import bucket_ms
from tickloom.operators.pairing import paired, symbols_of

# The measures, in the order that makes the (first, second) labels of the results.
SUMMED = ["logreturn", "total_volume", "volatility", "total_order_flow", "total_number_of_trades"]
AVERAGED = ["bid_ask_spread", "avg_arbitrage_spread", "effective_spread_ob"]
INTRA_MEASURES = [
    "total_volume", "avg_arbitrage_spread", "bid_ask_spread", "effective_spread_ob", "total_order_flow",
    "total_number_of_trades", "logreturn", "volatility",
]
CROSS_MEASURES = ["logreturn", "total_volume", "volatility", "bid_ask_spread"]
MATRIX_MEASURES = [
    "total_volume", "avg_arbitrage_spread", "bid_ask_spread", "effective_spread_ob", "total_order_flow",
    "total_number_of_trades", "logreturn", "volatility", "avg_arbitrage_profit",
]


def bucketed(series: DataFrame, seconds: int, measures: list[str]) -> DataFrame:
    """Series on a coarser raster: flows are summed, spreads averaged."""
    source = series.withColumn("volatility", F.col("logreturn") * F.col("logreturn"))
    aggregates = [(F.sum if name in SUMMED else F.avg)(name).alias(name) for name in measures]
    keys = [bucket_ms(F.col("start_ts_ob"), seconds).alias("ts_interval"), "symbol"]
    needed = [name for name in measures]
    return source.select(*keys, *needed).groupBy("ts_interval", "symbol").agg(*aggregates)


def pearson(points: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation, point count and t statistic per group of (x, y) points; incomplete points are skipped.

    Built from covariance and variances: undefined (null) rather than an error for a constant side.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    moments = (
        points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.covar_pop(x, y).alias("_cov"),
            F.var_pop(x).alias("_vx"),
            F.var_pop(y).alias("_vy"),
        )
    )
    return _correlated(moments, keys)


def measure_pairs(rows: DataFrame, measures: list[str]) -> DataFrame:
    """``pearson`` of every two measures per symbol, all moments side by side in one aggregate."""
    sets = []
    for first, second in combinations(measures, 2):
        a, b = F.col(first).cast("double"), F.col(second).cast("double")
        both = a.isNotNull() & b.isNotNull()
        x, y = F.when(both, a), F.when(both, b)
        sets.append(F.struct(
            F.lit(first).alias("first"), F.lit(second).alias("second"), F.count(x).alias("n"),
            F.covar_pop(x, y).alias("_cov"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"),
        ))
    moments = rows.groupBy("symbol").agg(F.array(*sets).alias("sets")).select("symbol", F.inline("sets"))
    return _correlated(moments.where("n > 0"), ["symbol", "first", "second"])


def _correlated(moments: DataFrame, keys: list[str]) -> DataFrame:
    r = F.try_divide("_cov", F.sqrt(F.col("_vx") * F.col("_vy")))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    return (
        moments.withColumn("correlation", F.when((F.col("n") > 1) & r.isNotNull(), bounded))
        .withColumn("t_statistic", correlation_t(F.col("correlation"), F.col("n")))
        .select(*keys, "n", "correlation", "t_statistic")
    )


def with_significance(correlations: DataFrame) -> DataFrame:
    """Adds the two-sided p-value; two points always correlate perfectly, so theirs is 1."""
    p = p_value(F.col("t_statistic"), F.col("n") - 2)
    return correlations.withColumn(
        "significance", F.when((F.col("n") == 2) & F.col("correlation").isNotNull(), F.lit(1.0)).otherwise(p)
    )


def intra_pair(series: DataFrame, seconds: int, measures: list[str] = INTRA_MEASURES) -> DataFrame:
    """Correlation of every two measures within each symbol.

    The moments of all pairs of measures are one map-side-combined row per symbol.
    """
    return measure_pairs(bucketed(series, seconds, measures), measures)


def cross_pair(series: DataFrame, seconds: int, measures: list[str] = CROSS_MEASURES, pairs: DataFrame | None = None, blocks: int = 1) -> DataFrame:
    """Correlation of one measure between every two symbols, or between those of ``pairs`` (see ``pairing.pair_list``).

    The join matches rows already reduced to one per (bucket, symbol), and its matches are combined map-side into one
    row per pair and measure. Without ``pairs`` the table of all symbol pairs is the result itself; ``blocks`` splits a
    bucket's pairs over tasks where there are many symbols (``pairing.symbol_blocks``).
    """
    if pairs is not None:
        series = symbols_of(series, pairs)
    matched = paired(bucketed(series, seconds, measures), "ts_interval", measures, pairs, blocks)
    point = lambda m: F.struct(F.lit(m).alias("measure"), F.col(f"x_{m}").cast("double").alias("x"), F.col(f"y_{m}").cast("double").alias("y"))
    points = F.inline(F.array(*[point(m) for m in measures]))
    return pearson(matched.select("first", "second", points), ["measure", "first", "second"])


def measure_matrix(clean_series: DataFrame, measures: list[str] = MATRIX_MEASURES) -> DataFrame:
    """Correlations of the unbucketed series over the rows on which all measures are known."""
    source = clean_series.withColumn("volatility", F.col("logreturn") * F.col("logreturn")).select("symbol", *measures)
    complete = source.dropna(subset=measures)
    return measure_pairs(complete, measures).select(
        "symbol", "first", "second", "correlation"
    )
