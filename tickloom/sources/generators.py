"""Tables that are computed rather than read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.timeexpr import DAY_MS, day_arg_to_ms, day_of_ms, iso_instant, raster_starts

PARITY_SYMBOL = "usdusd"


def time_grid(spark: SparkSession, first_day: str, end_day: str, minutes: int) -> DataFrame:
    """Bucket starts in ``[first_day, end_day)``, every ``minutes`` from each midnight on."""
    first, end = day_arg_to_ms(first_day), day_arg_to_ms(end_day)
    starts = spark.range(first, end, DAY_MS).select(F.explode(raster_starts(F.col("id"), first, end, minutes * 60_000)).alias("start"))
    return starts.select("start", iso_instant(F.col("start")).alias("start_display"))


def parity_rate(spark: SparkSession, first_day: str, end_day: str) -> DataFrame:
    """A daily rate of 1 for every day in ``[first_day, end_day)``."""
    days = spark.range(day_arg_to_ms(first_day), day_arg_to_ms(end_day), DAY_MS)
    return days.select(
        day_of_ms(F.col("id")).alias("day"),
        F.lit(PARITY_SYMBOL).alias("symbol"),
        F.lit(1.0).alias("average_daily_price"),
    )
