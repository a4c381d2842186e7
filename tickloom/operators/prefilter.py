"""A compact filter of join keys, put in front of the exchange of a much larger table.

The keys set two bits each in a bitmap, which reaches the scan as a scalar subquery: one array of longs, at most
MOST_BITS / 8 bytes at any number of keys. Rows whose bits aren't both set can't find a partner and stay out of the
shuffle; a few others pass, so the join itself still decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import stage

#: Bits for each key, as far as the bitmap may grow: with 16, one row in 70 passes by chance.
BITS_A_KEY = 16
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 26


def bitmap_bits(n_keys: int) -> int:
    """The size for so many keys, a power of two."""
    return min(max(1 << (max(n_keys * BITS_A_KEY, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)


def _places(columns: list[str | Column], bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(bits).cast("long")) for seed in (1, 2)]


def _mask(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))


def bitmap(keys: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """One row with the bitmap: an array of bits / 64 longs."""
    place = F.col("place")
    places = keys.select(F.explode(F.array(*_places(columns, bits))).alias("place"))
    words = places.select(F.shiftright(place, 6).alias("word"), _mask(place).alias("mask"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    dense = words.union(every).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    ordered = F.sort_array(F.collect_list(F.struct("word", "mask")))  # bits / 64 entries
    return dense.agg(F.transform(ordered, lambda x: x["mask"]).alias("bitmap"))


def may_be_in(keys: DataFrame, columns: list[str], at: list[Column] | None = None) -> Column:
    """Whether a row's ``columns`` (or the expressions ``at`` in their places) may be among those of ``keys``.

    ``keys`` is counted and read; pass a staged table.
    """
    bits = bitmap_bits(keys.count())
    held = stage(bitmap(keys, columns, bits), "key-bitmap").scalar()  # made once, however often a plan names it
    keep = F.lit(True)
    # equal numbers of different types have different hashes
    for place in _places([c.cast(keys.schema[n].dataType) for n, c in zip(columns, at or map(F.col, columns))], bits):
        word = F.get(held, F.shiftright(place, 6).cast("int"))
        keep = keep & (word.bitwiseAND(_mask(place)) != 0)
    return keep


def likely_in(df: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``df`` whose ``columns`` may be among those of ``keys``: all that are, and few others."""
    return df.where(may_be_in(keys, columns))
