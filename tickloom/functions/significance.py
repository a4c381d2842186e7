"""Two-sided p-values of Student-t statistics.

Applied to already aggregated rows (one per correlation or regression), so the Python step sees
only the result table, never the series. All steps work on whole Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Above this many degrees of freedom a normal deviate with two correction terms is exact to about 1e-12.
MANY = 1e4
STEPS = 5_000


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after moving small arguments up."""
    x, below = x.copy(), np.zeros_like(x)
    for _ in range(12):
        small = x < 12
        below[small] += np.log(x[small])
        x[small] += 1
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - below


def _lentz(first: np.ndarray, term) -> np.ndarray:
    """A continued fraction 1 / (1 + term(0) / (1 + term(1) / ...)); NaN where it does not settle within STEPS."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(first), 1 / guard(1 + first)
    value, open_ = d.copy(), np.ones(first.shape, dtype=bool)
    for m in range(1, STEPS):
        step = np.ones_like(value)
        for part in term(m):
            d, c = 1 / guard(1 + part * d), guard(1 + part / c)
            step = step * (c * d)
            value = np.where(open_, value * (c * d), value)
        open_ &= ~(np.abs(c * d - 1) < 1e-15)
        if not open_.any():
            return value
    return np.where(open_, np.nan, value)


def regularized_beta(a, b, x) -> np.ndarray:
    """The regularized incomplete beta function, element by element."""
    a, b, x = (v.astype("float64") for v in np.broadcast_arrays(np.atleast_1d(a), np.atleast_1d(b), np.atleast_1d(x)))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    swap = inner >= (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - inner, inner)

    def term(m):
        yield m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        yield -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))

    part = front * _lentz(-(p + q) * z / (p + 1), term) / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(swap, 1 - part, part)))


def _normal_two_sided(z: np.ndarray) -> np.ndarray:
    """Both tails of the standard normal distribution."""
    y = z * z / 2
    small = np.minimum(y, 3.0)
    term, total = np.ones_like(y), np.ones_like(y)
    for n in range(1, 60):  # the series settles long before, as small <= 3
        term = term * small / (n + 0.5)
        total = total + term
    inner = 2 / math.sqrt(math.pi) * np.sqrt(small) * np.exp(-small) * total
    large, deep = np.maximum(y, 3.0), np.zeros_like(y)
    for n in range(200, 0, -1):
        deep = n / 2 / (np.sqrt(large) + deep)
    outer = np.exp(-large) / math.sqrt(math.pi) / (np.sqrt(large) + deep)
    return np.where(y < 3.0, 1 - inner, outer)


def student_t_two_sided(t, df) -> np.ndarray:
    """Element by element; NaN where the statistic is undefined."""
    t, df = (v.astype("float64") for v in np.broadcast_arrays(np.atleast_1d(t), np.atleast_1d(df)))
    out = np.full(t.shape, np.nan)
    usable = ~np.isnan(t) & (df > 0)
    out[usable & np.isinf(t)] = 0.0
    few = usable & np.isfinite(t) & (df <= MANY)
    if few.any():
        out[few] = regularized_beta(df[few] / 2, 0.5, df[few] / (df[few] + t[few] ** 2))
    many = usable & np.isfinite(t) & (df > MANY)
    if many.any():
        n, square = df[many], t[many] ** 2
        # the deviate whose normal tails equal those of t, by the expansion in 1 / (n - 1/2)
        a, b = n - 0.5, 48 * (n - 0.5) ** 2
        z2 = a * np.log1p(square / n)
        z = np.sqrt(z2)
        z = z + (z**3 + 3 * z) / b - (4 * z**7 + 33 * z**5 + 240 * z**3 + 855 * z) / (10 * b * (b + 0.8 * z2**2 + 100))
        out[many] = _normal_two_sided(z)
    return out


def _p_values(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_t_two_sided(t.to_numpy("float64"), df.to_numpy("float64")), index=t.index, dtype="float64")


_p_value_udf = F.pandas_udf(_p_values, T.DoubleType())


def p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value; null where the statistic is undefined."""
    return F.nanvl(_p_value_udf(t.cast("double"), df.cast("double")), F.lit(None).cast("double"))


def correlation_t(r: Column, n: Column) -> Column:
    """t statistic of a Pearson correlation over n points; infinite where r is +-1."""
    left = 1.0 - r * r
    return F.when(n > 2, F.when(left <= 0, F.signum(r) * F.lit(math.inf)).otherwise(r * F.sqrt(F.try_divide(n - 2, left))))
