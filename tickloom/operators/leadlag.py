"""Lead-lag regressions between the returns of two symbols."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.measures import ieee_ratio
from tickloom.functions.significance import p_value
from tickloom.functions.timeexpr import DAY_MS, DAY_S, bucket_ms
from tickloom.operators.pairing import paired, symbols_of
from tickloom.session import stage

LAGS = list(range(11))
FOLLOWER_SHIFT = 5
#: Share of the squared total below which a residual is rounding noise.
PERFECT_FIT = 1e-12
PAIR = ["leader", "follower"]
FIT = [*PAIR, "interval"]


def lag_label(lag: int) -> str:
    """Lag 0 regresses on the leader five bins ahead of the follower, lag 10 on five bins behind."""
    ahead = FOLLOWER_SHIFT - lag
    return "t" if ahead == 0 else f"t{ahead:+d}"


def pair_bins(series: DataFrame, seconds: int, pairs: DataFrame | None = None, blocks: int = 1) -> DataFrame:
    """Mergeable returns of each unordered pair per bin, over the instants both symbols have: staged.

    For both sides (``x`` of ``first``, ``y`` of ``second``) a bin holds the number of known returns, their sum, the sum
    of squares about their mean, and the range. One join serves every interval and both directions.
    """
    known = F.nanvl(F.col("logreturn").cast("double"), F.lit(None).cast("double"))
    rows = series.select("start_ts_ob", "symbol", known.alias("r"))
    met = paired(rows, "start_ts_ob", ["r"], pairs, blocks)
    sides = [
        c for side in "xy" for value in [F.col(f"{side}_r")]
        for c in (
            F.count(value).alias(f"n{side}"), F.sum(value).alias(f"s{side}"), (F.var_pop(value) * F.count(value)).alias(f"q{side}"),
            F.min(value).alias(f"low_{side}"), F.max(value).alias(f"high_{side}"),
        )
    ]
    bins = met.groupBy("first", "second", bucket_ms(F.col("start_ts_ob"), seconds).alias("bin"))
    return stage(bins.agg(F.min("start_ts_ob").alias("first_ts"), *sides), "pair-bins")


def pair_scales(bins: DataFrame) -> DataFrame:
    """Mean and sample deviation of both sides of a pair, and its first instant, merged from its bins."""

    def scale(side: str) -> list[Column]:
        n, s = F.sum(f"n{side}"), F.sum(f"s{side}")
        between = F.sum(F.try_divide(F.col(f"s{side}") * F.col(f"s{side}"), F.col(f"n{side}"))) - F.try_divide(s * s, n)
        varied = F.min(f"low_{side}") < F.max(f"high_{side}")  # else only rounding is left of the difference
        squares = F.when(varied, F.greatest(F.sum(f"q{side}") + between, F.lit(0.0))).otherwise(F.lit(0.0))
        return [F.try_divide(s, n).alias(f"m{side}"), F.sqrt(F.try_divide(squares, n - 1)).alias(f"d{side}")]

    return bins.groupBy("first", "second").agg(F.min("first_ts").alias("first_ts"), *scale("x"), *scale("y"))


def standardized_bins(bins: DataFrame, intervals: list[int], flip_leader: bool = True) -> DataFrame:
    """Sums of z-scored returns per bin, for every interval (seconds) and both directions of a pair.

    Scoring is linear, so returns are summed per bin first and scored once per bin, not per row; coarser bins are sums
    of the finest, and the mirrored direction swaps the sides. ``first_ts`` is the pair's first instant.
    """
    places = [F.struct(F.lit(s).cast("long").alias("interval"), bucket_ms(F.col("bin"), s).alias("bin")) for s in intervals]
    wide = (
        bins.select("first", "second", "nx", "sx", "ny", "sy", F.inline(F.array(*places)))
        .groupBy("first", "second", "interval", "bin")
        .agg(*[F.sum(c).alias(c) for c in ("nx", "sx", "ny", "sy")])
    )

    def score(side: str) -> Column:
        return F.coalesce(F.try_divide(F.col(f"s{side}") - F.col(f"n{side}") * F.col(f"m{side}"), F.col(f"d{side}")), F.lit(0.0))

    scored = wide.join(pair_scales(bins), ["first", "second"]).withColumn("zx", score("x")).withColumn("zy", score("y"))
    sign = -1.0 if flip_leader else 1.0
    ways = [
        F.struct(F.col(a).alias("leader"), F.col(b).alias("follower"), (F.col(x) * sign).alias("x"), F.col(y).alias("y"))
        for a, b, x, y in (("first", "second", "zx", "zy"), ("second", "first", "zy", "zx"))
    ]
    return scored.select("interval", "first_ts", "bin", F.inline(F.array(*ways))).select(*FIT, "first_ts", "bin", "x", "y")


def lagged_rows(bins: DataFrame) -> DataFrame:
    """Regression rows: follower five bins back (``y``) and leader 0..10 bins back (``x0``..``x10``).

    Instead of ordering a pair's whole history in one window, each bin sends its value to the
    anchors that need it, and anchors are assembled by a grouped sum. A bin without rows
    contributes 0 to later anchors, but is no anchor itself, and neither are a pair's first ten bins.
    """
    step = F.col("interval") * 1000
    sent = bins.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in LAGS]))).select(
        *FIT, "first_ts", "lag", (F.col("bin") + F.col("lag") * step).alias("anchor"), "x", "y"
    )

    def at(lag: int, value: str):
        return F.coalesce(F.sum(F.when(F.col("lag") == lag, F.col(value))), F.lit(0.0))

    first_anchor = F.col("first_ts") - F.pmod(F.pmod(F.col("first_ts"), F.lit(DAY_MS)), step) + max(LAGS) * step
    return (
        sent.groupBy(*FIT, "first_ts", "anchor")
        .agg(
            F.min("lag").alias("nearest"),
            at(FOLLOWER_SHIFT, "y").alias("y"),
            *[at(k, "x").alias(f"x{k}") for k in LAGS],
        )
        .where((F.col("nearest") == 0) & (F.col("anchor") >= first_anchor))
        .drop("nearest", "first_ts")
    )


def regress(rows: DataFrame, perfect_fit: float = PERFECT_FIT) -> DataFrame:
    """One least-squares fit without intercept per (pair, interval, lag)."""
    sums = [F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("syy")]
    for k in LAGS:
        x = F.col(f"x{k}")
        sums += [F.sum(x * x).alias(f"sxx{k}"), F.sum(x * F.col("y")).alias(f"sxy{k}")]
    per_lag = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("lag"),
                    F.lit(lag_label(k)).alias("label"),
                    F.col(f"sxx{k}").alias("sxx"),
                    F.col(f"sxy{k}").alias("sxy"),
                )
                for k in LAGS
            ]
        )
    )
    beta = F.try_divide("sxy", "sxx")
    left = F.col("syy") - F.col("beta") * F.col("sxy")
    residual = F.when(left > perfect_fit * F.col("syy"), left).when(left.isNotNull(), F.lit(0.0))
    variance = F.try_divide(residual, F.col("n") - 1)
    return (
        rows.groupBy(*FIT)
        .agg(*sums)
        .select(*FIT, "n", "syy", per_lag)
        .withColumn("beta", beta)
        .withColumn("t_statistic", ieee_ratio(F.col("beta"), F.sqrt(F.try_divide(variance, F.col("sxx")))))
        .select(*FIT, "lag", "label", "n", "beta", "t_statistic")
    )


def lead_lag(
    series: DataFrame, intervals: list[int], flip_leader: bool = True, pairs: DataFrame | None = None, blocks: int = 1,
    perfect_fit: float = PERFECT_FIT,
) -> DataFrame:
    """Coefficients and t statistics for each ordered symbol pair, interval (seconds) and lag.

    ``pairs`` (see ``pairing.pair_list``) chooses pairs, each in both directions; by default all are taken, split over
    ``blocks`` of symbols. A residual of less than ``perfect_fit`` of the squared total counts as 0. Lags count even
    steps across midnights, so an interval must divide a day.
    """
    if odd := [s for s in intervals if DAY_S % s]:
        raise ValueError(f"intervals must divide {DAY_S} seconds, got {odd}")
    bins = pair_bins(series if pairs is None else symbols_of(series, pairs), gcd(*intervals), pairs, blocks)
    return regress(lagged_rows(standardized_bins(bins, intervals, flip_leader)), perfect_fit)


def with_p_value(fits: DataFrame) -> DataFrame:
    return fits.withColumn("p_value", p_value(F.col("t_statistic"), F.col("n") - 1))


def lead_lag_table(fits: DataFrame, value: str) -> DataFrame:
    """One row per (leader, follower, interval) with a column per regressor, furthest behind first."""
    labels = [lag_label(k) for k in reversed(LAGS)]
    return fits.groupBy(*FIT).pivot("label", labels).agg(F.first(value))
