"""Anomaly rules and outlier filters."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.timeexpr import day_of_ts
from tickloom.operators.grid import sized


class DayRule(NamedTuple):
    """Drop one symbol's rows of one day."""

    symbol: str
    day: str


class RangeRule(NamedTuple):
    """Keep one symbol's rows only where the column lies strictly inside (low, high); None is open."""

    symbol: str
    column: str
    low: float | None
    high: float | None


# Days and value ranges with known bad data.
ANOMALOUS_DAYS = [DayRule("ethpax", "2019-04-27")]
PRICE_RANGES = [RangeRule("tusdusd", "avg_price", 0.1, 500.0)]
SPREAD_CAPS = [
    RangeRule("tusdusdt", "bid_ask_spread", None, 1.0),
    RangeRule("paxusd", "bid_ask_spread", None, 1.0),
    RangeRule("tusdusd", "bid_ask_spread", None, 1.0),
    RangeRule("btcdai", "bid_ask_spread", None, 1000.0),
    RangeRule("btcpax", "bid_ask_spread", None, 1000.0),
    RangeRule("btctusd", "bid_ask_spread", None, 1000.0),
    RangeRule("btcusdc", "bid_ask_spread", None, 1000.0),
    RangeRule("ethpax", "bid_ask_spread", None, 1000.0),
    RangeRule("ethtusd", "bid_ask_spread", None, 1000.0),
]


def day_rules(rules: list[DayRule] = ANOMALOUS_DAYS, stamp: str = "start_second") -> Column:
    """One predicate for all rules, so it folds into the scan's filter instead of joining a rule table."""
    parts = [(F.col("symbol") != r.symbol) | (day_of_ts(F.col(stamp)) != r.day) for r in rules]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def range_rules(rules: list[RangeRule]) -> Column:
    def inside(rule: RangeRule) -> Column:
        column, keep = F.col(rule.column), F.lit(True)
        if rule.low is not None:
            keep = keep & (column > rule.low)
        if rule.high is not None:
            keep = keep & (column < rule.high)
        return (F.col("symbol") != rule.symbol) | keep

    return reduce(lambda a, b: a & b, [inside(r) for r in rules], F.lit(True))


def outlier_filter(df: DataFrame, keys: list[str], value: str, width: float = 3.0, bounded: bool = False) -> DataFrame:
    """Keep rows within ``width`` sample standard deviations of their group's mean (closed interval).

    A group of one row has no deviation and drops out. The bounds are a map-side-combined aggregate
    joined back, so a hot group never has to fit one task: the planner broadcasts the bounds when
    their size allows, and otherwise skew handling may split the group. ``df`` is read twice; pass
    a table or a staged frame.

    ``bounded`` says that a group holds a bounded number of rows, as the keys include a time bucket (at most its length
    over that of a bar). Then one window finds the bounds: one scan, and one exchange that a following aggregate by the
    same keys shares.
    """
    mean, deviation = F.avg(value), width * F.stddev_samp(value)
    if bounded:
        group = Window.partitionBy(*keys)
        marked = df.withColumn("_mean", F.avg(value).over(group)).withColumn("_reach", width * F.stddev_samp(value).over(group))
        inside = (F.col("_mean") - F.col("_reach") <= F.col(value)) & (F.col(value) <= F.col("_mean") + F.col("_reach"))
        return marked.where(inside).drop("_mean", "_reach")
    bounds = df.groupBy(*keys).agg((mean - deviation).alias("_lower"), (mean + deviation).alias("_upper"))
    return (
        df.join(bounds, keys)
        .where((F.col("_lower") <= F.col(value)) & (F.col(value) <= F.col("_upper")))
        .drop("_lower", "_upper")
    )


def replace_outliers(df: DataFrame, key: str, value: str, symbols: list[str] | None = None) -> DataFrame:
    """Set values three or more population deviations from their group's mean to that mean.

    Only the given symbols are touched, all when none are given.
    """
    stats = df.groupBy(key).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_dev"))
    inside = F.abs(F.col(value) - F.col("_mean")) < 3.0 * F.col("_dev")
    if symbols is not None:
        inside = inside | ~F.col(key).isin(*symbols)
    replaced = F.when(inside | F.col(value).isNull(), F.col(value)).otherwise(F.col("_mean"))
    return df.join(sized(stats), key).withColumn(value, replaced).drop("_mean", "_dev")
