"""Regular time grids and gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.timeexpr import DAY_MS, raster_starts
from tickloom.session import stage


def symbol_grid(symbols: DataFrame, first_ms: int, end_ms: int, step_ms: int) -> DataFrame:
    """(symbol, start) for every bucket start in ``[first_ms, end_ms)``, on the raster of the bucket functions.

    Each symbol row unrolls to days and each day, in a task of its own, to its buckets.
    """
    first_day = first_ms - first_ms % DAY_MS
    days = symbols.select("symbol").select(
        "symbol", F.explode(F.sequence(F.lit(first_day), F.lit(max(end_ms - 1, first_day)), F.lit(DAY_MS))).alias("_day")
    )
    return days.repartition("symbol", "_day").select(
        "symbol", F.explode(raster_starts(F.col("_day"), first_ms, end_ms, step_ms)).alias("start")
    )


def in_period(series: DataFrame, time: str, first_ms: int, end_ms: int) -> DataFrame:
    """Rows in ``[first_ms, end_ms)``. Apply it once, before a series is both gridded and summed up."""
    return series.where((F.col(time) >= first_ms) & (F.col(time) < end_ms))


def on_grid(series: DataFrame, time: str, first_ms: int, end_ms: int, step_ms: int) -> DataFrame:
    """Every symbol of ``series`` on the full grid; measures are null where it had no row."""
    grid = symbol_grid(series.select("symbol").distinct(), first_ms, end_ms, step_ms)
    return grid.join(series.withColumnRenamed(time, "start"), ["symbol", "start"], "left")


def zero_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """0 for null and NaN."""
    return df.na.fill(0, columns)


def fill_with_symbol_mean(df: DataFrame, column: str, series: DataFrame) -> DataFrame:
    """Missing values become the mean the symbol has in ``series``."""
    means = series.groupBy("symbol").agg(F.avg(column).alias("_mean"))
    known = F.nanvl(column, F.lit(None).cast("double"))
    joined = df.join(sized(means), "symbol", "left")
    return joined.withColumn(column, F.coalesce(known, F.col("_mean"))).drop("_mean")


def sized(per_symbol: DataFrame) -> DataFrame:
    """A table of one row per symbol, staged: made once, and its file size decides whether the planner broadcasts it.

    Beyond that size skew handling splits the symbols of the other side.
    """
    return stage(per_symbol, "per-symbol")
