"""Mergeable states of central moments.

A state of a column holds the number of its known values, their mean, the sums of the 2nd to 4th power of their deviations
from the mean, the range, the number of rows, and how many of them are 0 or null. States of fine groups (minutes) merge
exactly into those of coarse ones (months, symbols), and with any number of equal values in closed form, so that rows
need not be read again at each grain nor be made just to be counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.measures import number

FIELDS = ["n", "mean", "m2", "m3", "m4", "low", "high", "rows", "zeros"]
STATISTICS = ["mean", "stddev", "skewness", "kurtosis", "min", "max", "percentage_of_zeros", "variation_coefficient"]


def _of(name: str) -> dict[str, Column]:
    return {f: F.col(f"`{name}_{f}`") for f in FIELDS}


def _named(name: str, values: dict[str, Column]) -> list[Column]:
    return [values[f].alias(f"{name}_{f}") for f in FIELDS]


def state(value: Column, name: str, where: Column | None = None) -> list[Column]:
    """Aggregates that make the state of ``value`` over a group's rows, or over those ``where`` holds."""
    c = value.cast("double")
    rows, zero = F.lit(1), (number(c) == 0).cast("int")
    if where is not None:
        c, rows, zero = F.when(where, c), F.when(where, rows), F.when(where, zero)
    n, spread = F.count(c), F.coalesce(F.var_pop(c), F.lit(0.0)) * F.count(c)
    # skewness and kurtosis are null where nothing deviates
    third = F.coalesce(F.skewness(c) * F.try_divide(F.pow(spread, 1.5), F.sqrt(n.cast("double"))), F.lit(0.0))
    fourth = F.coalesce((F.kurtosis(c) + 3.0) * F.try_divide(spread * spread, n), F.lit(0.0))
    return _named(
        name,
        {
            "n": n, "mean": F.avg(c), "m2": spread, "m3": third, "m4": fourth, "low": F.min(c), "high": F.max(c),
            "rows": F.count(rows), "zeros": F.coalesce(F.sum(zero), F.lit(0)),
        },
    )


def centers(parts: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Means of the merged groups, as ``<name>_center``."""
    means = [F.try_divide(F.sum(s["n"] * s["mean"]), F.sum(s["n"])).alias(f"{name}_center") for name in names for s in [_of(name)]]
    return parts.groupBy(*keys).agg(*means)


def merged(name: str) -> list[Column]:
    """Aggregates that merge the states of a group, on rows that carry its ``<name>_center``.

    Deviations are taken from the merged mean, which loses no digits where the mean is far from 0.
    """
    s = _of(name)
    d, n = s["mean"] - F.col(f"`{name}_center`"), s["n"]
    low, high = F.min(s["low"]), F.max(s["high"])
    varied = low < high  # else only rounding is left of the sums
    moment = lambda total: F.when(varied, F.coalesce(F.sum(total), F.lit(0.0))).otherwise(F.lit(0.0))
    return _named(
        name,
        {
            "n": F.sum(n), "mean": F.max(f"{name}_center"), "low": low, "high": high, "rows": F.sum(s["rows"]), "zeros": F.sum(s["zeros"]),
            "m2": moment(s["m2"] + n * d * d),
            "m3": moment(s["m3"] + 3.0 * d * s["m2"] + n * d * d * d),
            "m4": moment(s["m4"] + 4.0 * d * s["m3"] + 6.0 * d * d * s["m2"] + n * d * d * d * d),
        },
    )


def merge(parts: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """The states of coarser groups. ``parts`` is read twice: pass a staged table."""
    return parts.join(centers(parts, keys, names), keys).groupBy(*keys).agg(*[c for name in names for c in merged(name)])


def with_zeros(states: DataFrame, name: str, cells: Column) -> DataFrame:
    """``states`` whose rows and known values are filled up with zeros to the number of ``cells``."""
    s = _of(name)
    n, k = s["n"].cast("double"), F.greatest(cells - s["rows"], F.lit(0)).cast("double")
    total, mean = n + k, F.coalesce(s["mean"], F.lit(0.0))
    share = lambda x, power: F.coalesce(F.try_divide(x, F.pow(total, float(power))), F.lit(0.0))
    filled = k > 0
    low, high = (F.when(filled, f(F.coalesce(s[e], F.lit(0.0)), F.lit(0.0))).otherwise(s[e]) for f, e in ((F.least, "low"), (F.greatest, "high")))
    varied = low < high
    out = {
        "n": s["n"] + k.cast("long"), "mean": F.try_divide(n * mean, total), "low": low, "high": high,
        "rows": s["rows"] + k.cast("long"), "zeros": s["zeros"] + k.cast("long"),
        "m2": s["m2"] + share(mean * mean * n * k, 1),
        "m3": s["m3"] - share(mean * mean * mean * n * k * (n - k), 2) + share(3.0 * mean * k * s["m2"], 1),
        "m4": s["m4"] + share(F.pow(mean, 4.0) * n * k * (n * n - n * k + k * k), 3) + share(6.0 * mean * mean * k * k * s["m2"], 2)
        + share(4.0 * mean * k * s["m3"], 1),
    }
    out |= {m: F.when(varied, out[m]).otherwise(F.lit(0.0)) for m in ("m2", "m3", "m4")}
    rest = [c for c in states.columns if c not in {f"{name}_{f}" for f in FIELDS}]
    return states.select(*[F.col(f"`{c}`") for c in rest], *_named(name, out))


def sample_deviation(name: str) -> Column:
    s = _of(name)
    return F.sqrt(F.try_divide(s["m2"], F.when(s["n"] > 1, s["n"] - 1)))


def statistics(states: DataFrame, names: list[str]) -> DataFrame:
    """One row per (symbol, name) in the layout of ``descriptive.describe``."""
    rows = []
    for name in names:
        s = _of(name)
        n = s["n"].cast("double")
        stddev = sample_deviation(name)
        values = {
            "mean": s["mean"], "stddev": stddev,
            "skewness": F.try_divide(F.sqrt(n) * s["m3"], F.pow(s["m2"], 1.5)),
            "kurtosis": F.try_divide(n * s["m4"], s["m2"] * s["m2"]) - 3.0,
            "min": s["low"], "max": s["high"],
            "percentage_of_zeros": F.coalesce(F.try_divide(s["zeros"].cast("double"), s["rows"].cast("double")), F.lit(0.0)),
            "variation_coefficient": F.try_divide(stddev, s["mean"]),
        }
        rows.append(F.struct(*[values[v].alias(v) for v in STATISTICS], F.lit(name).alias("type")))
    return states.select("symbol", F.inline(F.array(*rows))).select(*STATISTICS, "type", "symbol")
