"""Two symbols' rows on common instants, for chosen pairs or for all of them."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Symbols of one block: an instant's pairs are made in tasks of at most this number squared.
BLOCK_SYMBOLS = 256


def pair_list(spark: SparkSession, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """(first, second) of each two different symbols, in alphabetical order, once."""
    rows = {tuple(sorted(pair)) for pair in pairs}
    if odd := [p for p in rows if p[0] == p[1]]:
        raise ValueError(f"a symbol is not paired with itself: {odd}")
    return spark.createDataFrame(sorted(rows), "first string, second string")


def symbols_of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows whose symbol is in some pair."""
    return rows.join(pairs.select(F.explode(F.array("first", "second")).alias("symbol")).distinct(), "symbol", "left_semi")


def symbol_blocks(rows: DataFrame) -> int:
    """The number of blocks for all pairs of the symbols in ``rows`` (a staged table, as it is counted)."""
    return max(1, -(-rows.select("symbol").distinct().count() // BLOCK_SYMBOLS))


def paired(rows: DataFrame, time: str, values: list[str], pairs: DataFrame | None = None, blocks: int = 1) -> DataFrame:
    """Unordered pairs (``first`` < ``second``) on equal ``time``, with ``x_`` and ``y_`` columns of their values.

    ``rows`` holds (time, symbol, values) and is read twice. With ``pairs`` a row meets only its listed partners: the
    join is by time and partner, so that a busy instant spreads over its symbols. Without, all pairs are the result;
    then symbols fall into ``blocks`` by hash, a row goes once to each pair of blocks that holds its own, and a task
    makes the pairs of one instant and two blocks.
    """
    if pairs is not None:
        rows = symbols_of(rows, pairs)
        left = rows.withColumnRenamed("symbol", "first").join(pairs, "first")
        right = rows.withColumnRenamed("symbol", "second")
        keys = [time, "second"]
        met = reduce(lambda d, v: d.withColumnRenamed(v, f"x_{v}"), values, left)
        return met.join(reduce(lambda d, v: d.withColumnRenamed(v, f"y_{v}"), values, right), keys)
    sides = []
    for side, mark in (("first", "x"), ("second", "y")):
        named = rows.select(time, F.col("symbol").alias(side), *[F.col(v).alias(f"{mark}_{v}") for v in values])
        if blocks > 1:
            own = F.pmod(F.xxhash64(side), F.lit(blocks))
            other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_other")
            named = named.select("*", own.alias(f"_{side}"), other)
            own = F.col(f"_{side}")
            named = named.withColumn("_low", F.least(own, "_other")).withColumn("_high", F.greatest(own, "_other")).drop("_other")
        sides.append(named)
    if blocks == 1:
        return sides[0].join(sides[1], time).where(F.col("first") < F.col("second"))
    met = sides[0].join(sides[1], [time, "_low", "_high"]).where(F.col("first") < F.col("second"))
    # two symbols of one block also meet where it stands beside another
    once = (F.col("_low") == F.least("_first", "_second")) & (F.col("_high") == F.greatest("_first", "_second"))
    return met.where(once).drop("_low", "_high", "_first", "_second")
