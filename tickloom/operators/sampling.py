"""Every k-th row of an ordered series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.timeexpr import day_of_ts


def stride_sample(series: DataFrame, time: str, samples: int | None, day: str | None = None) -> DataFrame:
    """Rows 1, 1+k, 1+2k, ... of each symbol in time order, with k = length // samples (at least 1).

    Positions are counted per (symbol, day) and offset by the earlier days' row counts, so no task
    orders a symbol's whole history. ``day`` names the day column of a daily series; otherwise
    ``time`` is a timestamp.
    """
    if not samples:
        return series
    keyed = series.withColumn("_day", F.col(day).cast("string") if day else day_of_ts(F.col(time)))
    counts = keyed.groupBy("symbol", "_day").agg(F.count("*").alias("_rows"))
    per_symbol = Window.partitionBy("symbol")  # one row per day
    earlier = per_symbol.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "symbol",
        "_day",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(per_symbol).alias("_length"),
    )
    in_day = F.row_number().over(Window.partitionBy("symbol", "_day").orderBy(time))
    length = F.col("_length")
    step = F.when(length > samples, F.floor(length / samples)).otherwise(F.lit(1))
    return (
        keyed.join(offsets, ["symbol", "_day"])
        .withColumn("_position", F.col("_before") + in_day - 1)
        .where(F.pmod(F.col("_position"), step) == 0)
        .drop("_day", "_before", "_length", "_position")
    )
