"""Aggregate measures as column builders, with the engine's missing-value rules.

A null price, amount or measure counts as 0 and a null side as a buy; a price over zero volume is
NaN; the conditional averages are 0, not null, when nothing qualifies.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")
#: Adding and taking away 1.5 * 2**52 * unit rounds a double to a multiple of the unit: 2**14, 2**-16, 2**-46.
_ROUNDERS = [1.5 * 2.0**66, 1.5 * 2.0**36, 1.5 * 2.0**6]
_LARGE = 2.0**60


def number(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def is_sell(sell: Column) -> Column:
    return F.coalesce(sell, F.lit(False))


def is_positive(c: Column) -> Column:
    """Spark orders NaN above every number, so positivity has to exclude it."""
    return ~F.isnan(c) & (c > 0)


def exact_sum(value: Column) -> Column:
    """Sum of doubles, the same to the last bit in any order of rows and partitions.

    Values are cut into parts of 30 bits that add without rounding (2**23 values of 2**-24 or more to a group), and the
    parts' sums are added from the smallest. Values beyond 2**60, infinity and NaN are summed as they are. ``value`` is
    written out many times: pass a column, not an expression.
    """
    large, rest, sums = F.abs(value) >= _LARGE, value, []
    for rounder in _ROUNDERS:
        part = (rest + rounder) - rounder
        rest = rest - part
        sums.append(F.sum(F.when(large, F.lit(0.0)).otherwise(part)))
    small = F.sum(F.when(large, F.lit(0.0)).otherwise(rest))
    return F.sum(F.when(large, value).otherwise(F.lit(0.0))) + (sums[0] + (sums[1] + (sums[2] + small)))


def vwap(price: Column, amount: Column, where: Column | None = None) -> Column:
    notional, volume = number(price) * number(amount), number(amount)
    if where is not None:
        notional, volume = F.when(where, notional), F.when(where, volume)
    return F.coalesce(F.try_divide(F.sum(notional), F.sum(volume)), F.lit(NAN))


def volume(amount: Column, where: Column | None = None) -> Column:
    value = number(amount)
    if where is not None:
        value = F.when(where, value).otherwise(F.lit(0.0))
    return F.coalesce(F.sum(value), F.lit(0.0))


def order_flow(sell: Column, amount: Column) -> Column:
    return F.sum(F.when(is_sell(sell), -number(amount)).otherwise(number(amount)))


def at_lowest(value: Column, price: Column, tie: Column, default) -> Column:
    """``value`` of the row with the lowest price; equal prices go to the smallest ``tie``."""
    order = F.when(~F.isnan(number(price)), F.struct(number(price), tie))
    return F.coalesce(F.min_by(value, order), F.lit(default))


def at_highest(value: Column, price: Column, tie: Column, default) -> Column:
    """``value`` of the row with the highest positive price; ties as in :func:`at_lowest`."""
    order = F.when(is_positive(number(price)), F.struct(-number(price), tie))
    return F.coalesce(F.min_by(value, order), F.lit(default))


def opening(value: Column, time: Column) -> Column:
    return F.min_by(value, time)


def closing(value: Column, time: Column) -> Column:
    return F.max_by(value, time)


def natural_log(x: Column) -> Column:
    """IEEE logarithm: -inf at 0 and NaN below, where Spark's own is null."""
    return (
        F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(F.ln(x))
    )


def _ratio(num: Column, den: Column) -> Column:
    """IEEE division: signed infinity or NaN over zero, where ANSI Spark raises."""
    over_zero = F.when((num == 0) | F.isnan(num), F.lit(NAN)).otherwise(F.signum(num) * F.lit(INF))
    return F.when(den == 0, over_zero).otherwise(F.try_divide(num, den))


ieee_ratio = _ratio


def log_return(price: Column, time: Column) -> Column:
    """Logarithmic return from the earliest to the latest price."""
    return natural_log(_ratio(closing(number(price), time), opening(number(price), time)))


def simple_return(price: Column, time: Column) -> Column:
    """Relative change from the earliest to the latest price."""
    first, last = opening(number(price), time), closing(number(price), time)
    return _ratio(last - first, first)


def range_return(open_price: Column, close_price: Column) -> Column:
    """Relative distance from the lowest open to the highest close."""
    low, high = F.min(number(open_price)), F.max(number(close_price))
    return _ratio(high - low, low)


def avg_if_positive(c: Column) -> Column:
    return F.coalesce(F.avg(F.when(is_positive(c), c)), F.lit(0.0))


def count_if_positive(c: Column) -> Column:
    return F.count_if(is_positive(c))


def avg_if_not_null(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def fraction_of_zeros(c: Column) -> Column:
    """Share of rows that are 0 or null; 0 over no rows."""
    return F.coalesce(F.avg(F.when(number(c) == 0, F.lit(1.0)).otherwise(F.lit(0.0))), F.lit(0.0))


def realized_variance(r: Column) -> Column:
    return F.coalesce(F.sum(number(r) * number(r)), F.lit(0.0))


def realized_volatility(r: Column) -> Column:
    return F.sqrt(realized_variance(r))


def constant_of(c: Column, name: str) -> Column:
    """The single value ``c`` takes in the group; the query fails where it takes two."""
    return F.when(F.min(c).eqNullSafe(F.max(c)), F.max(c)).otherwise(
        F.raise_error(F.lit(f"{name} differs within a group"))
    )


AGGREGATES = {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count}


def aggregate_by_name(name: str, column: str) -> Column:
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}, use one of {sorted(AGGREGATES)}")
    return AGGREGATES[name](column)
