"""Sinks."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.timeexpr import month_of_ms

CSV_TIMESTAMPS = "yyyy-MM-dd'T'HH:mm:ssXXX"


def _csv(df: DataFrame, path: str, gzip: bool) -> None:
    writer = df.write.option("header", True).option("timestampFormat", CSV_TIMESTAMPS)
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.csv(path)


def write_sorted(df: DataFrame, path: str, *order: str) -> None:
    """Gzip CSV parts in one global order (a range shuffle; no single-task funnel)."""
    _csv(df.orderBy(*order), path, gzip=True)


def write_parts(df: DataFrame, path: str, gzip: bool = False) -> None:
    _csv(df, path, gzip)


def write_report(df: DataFrame, path: str, *order: str) -> None:
    """One CSV file. Only for finished reports: the upstream work keeps its own parallelism."""
    single = df.repartition(1)
    _csv(single.sortWithinPartitions(*order) if order else single, path, gzip=False)


def write_twice(df: DataFrame, parts_path: str, report_path: str, *order: str) -> None:
    """Sorted gzip parts and a single-file copy; the copy is made from the parts already written."""
    write_sorted(df, parts_path, *order)
    reader = df.sparkSession.read.schema(df.schema).option("header", True)
    write_report(reader.option("timestampFormat", CSV_TIMESTAMPS).csv(parts_path), report_path, *order)


def write_partitioned(df: DataFrame, path: str, time_ms: str = "date") -> None:
    """Parquet by symbol and month, the layout that month selection prunes."""
    (
        df.withColumn("year_month", month_of_ms(F.col(time_ms)))
        .write.partitionBy("symbol", "year_month")
        .parquet(path)
    )


def run_name(job: str, pair: str, first: str = "", last: str = "", step: str = "", now: datetime | None = None) -> str:
    """``<utc time>_<job>_<pair>_<from>_<to>_<step>``, leaving out what is empty."""
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y-%m-%d__%H-%M-%S")
    return "_".join(part for part in (stamp, job, pair, first, last, step) if part)
