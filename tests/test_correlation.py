import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.significance import student_t_two_sided
from tickloom.operators import correlation as corr


@pytest.mark.parametrize(
    "t, df, p",
    # published two-sided critical values of the t distribution
    [(12.706, 1, 0.05), (4.303, 2, 0.05), (2.571, 5, 0.05), (2.228, 10, 0.05), (2.042, 30, 0.05), (1.980, 120, 0.05),
     (63.657, 1, 0.01), (3.169, 10, 0.01), (2.617, 120, 0.01), (3.291, 10**7, 0.001)],
)
def test_student_t_table(t, df, p):
    assert student_t_two_sided(t, df) == pytest.approx(p, rel=2e-3)
    assert student_t_two_sided(-t, df) == student_t_two_sided(t, df)


def test_student_t_edges():
    assert student_t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert student_t_two_sided(math.inf, 5) == 0.0
    assert math.isnan(student_t_two_sided(1.0, 0))
    # one and two degrees of freedom have closed forms
    assert student_t_two_sided(3.7, 1) == pytest.approx(1 - 2 / math.pi * math.atan(3.7), rel=1e-12)
    assert student_t_two_sided(3.7, 2) == pytest.approx(1 - 3.7 / math.sqrt(2 + 3.7**2), rel=1e-12)


def pearson(spark, rows):
    df = spark.createDataFrame(rows, "k string, x double, y double")
    return {r.k: r for r in corr.with_significance(corr.pearson(df, ["k"])).collect()}


def test_pearson(spark):
    rng = random.Random(3)
    xs = [rng.gauss(5, 2) for _ in range(50)]
    ys = [x * 0.4 + rng.gauss(0, 1) for x in xs]
    rows = [("random", x, y) for x, y in zip(xs, ys)] + [("random", None, 1.0), ("random", 2.0, None)]
    rows += [("constant", 1.0, float(i)) for i in range(5)]
    rows += [("two", 1.0, 2.0), ("two", 2.0, 1.0)] + [("one", 1.0, 1.0)]
    rows += [("line", float(i), 2.0 * i) for i in range(8)]
    got = pearson(spark, rows)
    r = np.corrcoef(xs, ys)[0, 1]
    assert (got["random"].n, got["random"].correlation) == (50, pytest.approx(r))
    assert got["random"].t_statistic == pytest.approx(r * math.sqrt(48 / (1 - r * r)))
    assert 0 < got["random"].significance < 0.01
    assert (got["constant"].correlation, got["constant"].significance) == (None, None)
    assert (got["two"].correlation, got["two"].significance) == (pytest.approx(-1.0), 1.0)
    assert (got["one"].correlation, got["one"].significance) == (None, None)
    assert got["line"].correlation == pytest.approx(1.0)
    assert got["line"].significance == pytest.approx(0.0, abs=1e-12)


def test_cross_pair_matches_numpy(spark):
    rng = random.Random(5)
    rows = [(60_000 * i, s, rng.gauss(0, 1), rng.random(), rng.random()) for i in range(240) for s in ("a", "b", "c") if rng.random() > 0.2]
    series = spark.createDataFrame(rows, "start_ts_ob long, symbol string, logreturn double, total_volume double, bid_ask_spread double")
    got = {(r.measure, r["first"], r["second"]): r for r in corr.cross_pair(series, 300).collect()}
    assert len(got) == 4 * 3
    bins = {}
    for t, s, r, v, b in rows:
        bins.setdefault((t // 300_000, s), []).append((r, v, b))
    common = [k for k, s in bins if s == "a" and (k, "b") in bins]
    for measure, fold in (
        ("logreturn", lambda x: sum(r for r, _, _ in x)), ("total_volume", lambda x: sum(v for _, v, _ in x)),
        ("volatility", lambda x: sum(r * r for r, _, _ in x)), ("bid_ask_spread", lambda x: np.mean([b for _, _, b in x])),
    ):
        want = np.corrcoef([fold(bins[k, "a"]) for k in common], [fold(bins[k, "b"]) for k in common])[0, 1]
        assert got[measure, "a", "b"].correlation == pytest.approx(want)
        assert got[measure, "a", "b"].n == len(common)


def test_cross_pair_is_combined_before_the_shuffle(spark):
    series = spark.createDataFrame([(0, "a", 1.0, 1.0, 1.0)], "start_ts_ob long, symbol string, logreturn double, total_volume double, bid_ask_spread double")
    plan = corr.cross_pair(series, 300)._jdf.queryExecution().executedPlan().toString()
    # the partial moments sit between the join and the last exchange
    assert "partial_covar_pop" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_measure_matrix_leaves_out_incomplete_rows(spark):
    rows = [("s", 1.0, 2.0), ("s", 2.0, 4.0), ("s", 3.0, 7.0), ("s", 9.0, None)]
    df = spark.createDataFrame(rows, "symbol string, logreturn double, total_volume double")
    got = corr.measure_matrix(df, ["logreturn", "total_volume", "volatility"]).collect()
    assert len(got) == 3
    by = {(r["first"], r["second"]): r.correlation for r in got}
    assert by["logreturn", "volatility"] == pytest.approx(np.corrcoef([1, 2, 3], [1, 4, 9])[0, 1])


@pytest.mark.parametrize("df", [1e4, 1e5, 1e7, 1e9, 1e10])
@pytest.mark.parametrize("t", [0.01, 1.0, 3.0, 8.0])
def test_student_t_of_many_degrees_of_freedom(t, df):
    """Next to the normal tails, to the first order in 1 / df."""
    normal = math.erfc(t / math.sqrt(2))
    shift = (t**3 + t) / (2 * df) * math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    assert student_t_two_sided(t, df)[0] == pytest.approx(normal + shift, rel=1e-6 + t**8 / df**2)
