"""Descriptive statistics of several columns in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.measures import fraction_of_zeros

STATISTICS = ["mean", "stddev", "skewness", "kurtosis", "min", "max", "percentage_of_zeros"]


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per (symbol, column): a single grouped aggregate, turned to long form on its tiny result."""
    aggregates = []
    for name in columns:
        c = F.col(name).cast("double")
        aggregates.append(
            F.struct(
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("stddev"),
                F.skewness(c).alias("skewness"),
                F.kurtosis(c).alias("kurtosis"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
                fraction_of_zeros(c).alias("percentage_of_zeros"),
                F.lit(name).alias("type"),
            )
        )
    wide = df.groupBy("symbol").agg(F.array(*aggregates).alias("rows"))
    return wide.select("symbol", F.inline("rows")).select(
        *STATISTICS, F.try_divide("stddev", "mean").alias("variation_coefficient"), "type", "symbol"
    )
