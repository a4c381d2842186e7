"""Rows of documents picked out by keys, with no text shuffled that isn't concerned.

A compact filter of the keys (``operators.prefilter``) parts the rows at the scan: most can't be concerned and stay where
they are, the others are joined. Beyond some ten million keys the filter says little, and all rows go through the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tickloom.operators.prefilter import may_be_in


def parted(docs: DataFrame, keys: DataFrame, at: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key, rows that have none). ``at``: expressions over ``docs``, in the order and of the types of ``keys``' columns."""
    maybe = may_be_in(keys, keys.columns, at)
    return docs.where(maybe), docs.where(~maybe)


def same(keys: DataFrame, at: list[Column]) -> Column:
    condition = None
    for name, value in zip(keys.columns, at):
        equal = value.eqNullSafe(keys[name])
        condition = equal if condition is None else condition & equal
    return condition


def without(docs: DataFrame, keys: DataFrame, at: list[Column]) -> DataFrame:
    """Rows of ``docs`` whose ``at`` isn't among ``keys``, a staged table of names that ``docs`` doesn't have."""
    maybe, rest = parted(docs, keys, at)
    return rest.union(maybe.join(keys, same(keys, at), "left_anti"))
