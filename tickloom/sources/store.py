"""A store of large tables: Parquet by symbol and month, sorted by time inside each month.

Rows are dealt by ranges of (symbol, month, time), so a month of a busy symbol becomes as many files as it needs while a
quiet one shares its task with others, and the statistics of each file cover a narrow stretch of time. Selections by symbol
and month prune folders when the query is planned.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.timeexpr import month_of_ms
from tickloom.sources import schemas

PARTITIONS = ["symbol", "year_month"]


class Kind(NamedTuple):
    """A table that can be stored: its schema, and the column (epoch ms or timestamp) that says when."""

    schema: T.StructType
    time: str


KINDS = {
    "trades": Kind(schemas.TRADES, "date"),
    "book": Kind(T.StructType([*schemas.ORDER_BOOK.fields, T.StructField("symbol", T.StringType())]), "date"),
    "bars": Kind(schemas.ARBITRAGE, "start_second"),
    "book-series": Kind(schemas.BOOK_SERIES, "start_ts_ob"),
    "clean-series": Kind(schemas.CLEAN_SERIES, "start_ts_ob"),
}


class Selection(NamedTuple):
    """One symbol (None: all) over an inclusive range of months (None: open)."""

    symbol: str | None = None
    first_month: str | None = None
    last_month: str | None = None

    def condition(self) -> Column:
        if self.first_month and self.last_month and self.first_month > self.last_month:
            raise ValueError(f"month range {self.first_month}..{self.last_month} is reversed")
        parts = [F.lit(True)]
        if self.symbol:
            parts.append(F.col("symbol") == self.symbol)
        if self.first_month:
            parts.append(F.col("year_month") >= self.first_month)
        if self.last_month:
            parts.append(F.col("year_month") <= self.last_month)
        return reduce(lambda a, b: a & b, parts)


def _month(df: DataFrame, time: str) -> Column:
    ms = F.unix_millis(time) if isinstance(df.schema[time].dataType, T.TimestampType) else F.col(time)
    return month_of_ms(ms)


def write(df: DataFrame, path: str, kind: str) -> None:
    """Add ``df`` to the store at ``path``, replacing the (symbol, month) folders it has rows for and no others.

    Rows without a symbol or a time are stored under a folder for null.
    """
    time = KINDS[kind].time
    rows = df.select(*KINDS[kind].schema.names).withColumn("year_month", _month(df, time))
    order = [*PARTITIONS, time]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def read(spark: SparkSession, path: str, kind: str, selections: list[Selection] | None = None) -> DataFrame:
    """The stored table, or the rows of any of ``selections``."""
    schema = KINDS[kind].schema
    stored = T.StructType([f for f in schema.fields if f.name not in PARTITIONS])
    typed = T.StructType([*stored.fields, *[T.StructField(p, T.StringType()) for p in PARTITIONS]])
    table = spark.read.schema(typed).parquet(path)
    if selections:
        table = table.where(reduce(lambda a, b: a | b, [s.condition() for s in selections]))
    return table.select(*schema.names)
