import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.operators.cleaning import SPREAD_CAPS, PRICE_RANGES, day_rules, outlier_filter, range_rules, replace_outliers
from tickloom.operators.descriptive import describe
from tickloom.functions.timeexpr import bucket_ms
from tickloom.operators.grid import fill_with_symbol_mean, on_grid, symbol_grid, zero_fill
from tickloom.operators.sampling import stride_sample
from tickloom.sources.generators import time_grid

UTC = dt.timezone.utc


def test_outliers_and_single_row_groups(spark):
    rows = [("a", 1, 10.0 + i % 2) for i in range(40)] + [("a", 1, 1000.0), ("a", 2, 5.0), ("b", 1, 1000.0), ("b", 1, 1000.0)]
    df = spark.createDataFrame(rows, "symbol string, bucket long, v double")
    kept = outlier_filter(df, ["symbol", "bucket"], "v").groupBy("symbol", "bucket").count().collect()
    # the lone row of (a, 2) has no deviation and drops; equal values lie on the closed bounds and stay
    assert sorted(tuple(r) for r in kept) == [("a", 1, 40), ("b", 1, 2)]


def test_outlier_filter_has_no_window_over_the_group(spark):
    df = spark.createDataFrame([("a", 1.0)], "symbol string, v double")
    plan = outlier_filter(df, ["symbol"], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_bounded_groups_take_one_scan_and_one_exchange(spark):
    rows = [("a", i % 7, 10.0 + i % 3 + (90.0 if i == 33 else 0.0)) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, bucket long, v double")
    plain = outlier_filter(df, ["symbol", "bucket"], "v").collect()
    bounded = outlier_filter(df, ["symbol", "bucket"], "v", bounded=True)
    assert sorted(map(tuple, bounded.collect())) == sorted(map(tuple, plain))
    grouped = bounded.groupBy("bucket", "symbol").count()._jdf.queryExecution().executedPlan().toString()
    assert grouped.count("Exchange hashpartitioning") == 1 and "Join" not in grouped


def test_rules(spark):
    stamp = lambda d: dt.datetime(2019, 4, d, 12, tzinfo=UTC)
    rows = [
        ("ethpax", stamp(27), 200.0), ("ethpax", stamp(28), 200.0), ("ethusd", stamp(27), 200.0),
        ("tusdusd", stamp(1), 0.1), ("tusdusd", stamp(1), 1.0), ("tusdusd", stamp(1), 500.0), ("tusdusd", stamp(1), float("nan")),
    ]
    df = spark.createDataFrame(rows, "symbol string, start_second timestamp, avg_price double")
    kept = df.where(day_rules() & range_rules(PRICE_RANGES)).collect()
    assert sorted((r.symbol, r.avg_price) for r in kept) == [("ethpax", 200.0), ("ethusd", 200.0), ("tusdusd", 1.0)]


def test_spread_caps(spark):
    rows = [("paxusd", 0.5), ("paxusd", 1.0), ("btcdai", 999.0), ("btcdai", 1000.0), ("btcusd", 5000.0)]
    df = spark.createDataFrame(rows, "symbol string, bid_ask_spread double")
    kept = sorted(tuple(r) for r in df.where(range_rules(SPREAD_CAPS)).collect())
    assert kept == [("btcdai", 999.0), ("btcusd", 5000.0), ("paxusd", 0.5)]


def test_replace_outliers(spark):
    rows = [("usdtusd", 1.0)] * 20 + [("usdtusd", 100.0)] + [("btcusd", 1.0)] * 20 + [("btcusd", 100.0)]
    df = spark.createDataFrame(rows, "symbol string, v double")
    out = replace_outliers(df, "symbol", "v", ["usdtusd"])
    top = {r.symbol: r.m for r in out.groupBy("symbol").agg(F.max("v").alias("m")).collect()}
    assert top == {"usdtusd": pytest.approx(120 / 21), "btcusd": 100.0}


def test_describe(spark):
    rows = [("a", 1.0, 5), ("a", 2.0, 5), ("a", 4.0, 5), ("a", 0.0, 5), ("a", None, 5)]
    got = {r.type: r for r in describe(spark.createDataFrame(rows, "symbol string, x double, k int"), ["x", "k"]).collect()}
    x = got["x"]
    assert (x["mean"], x["min"], x["max"], x.percentage_of_zeros) == (1.75, 0.0, 4.0, 0.4)
    assert x["stddev"] == pytest.approx(1.70782512)
    assert x["skewness"] == pytest.approx(0.43465079)
    assert x["kurtosis"] == pytest.approx(-1.15428571, abs=1e-6)
    assert x["variation_coefficient"] == pytest.approx(1.70782512 / 1.75)
    assert (got["k"]["stddev"], got["k"]["skewness"]) == (0.0, None)


@pytest.mark.parametrize("step", [3_600_000, 25_000_000, 7_000_000, 86_400_000])
@pytest.mark.parametrize("first", [3 * 86_400_000, 3 * 86_400_000 + 5])
def test_grid_restarts_at_midnight(spark, step, first):
    day, end = 86_400_000, 86_400_000 * 6 - 1000
    symbols = spark.createDataFrame([("a",), ("b",)], "symbol string")
    got = symbol_grid(symbols, first, end, step).collect()
    want = [t for d in range(3, 6) for t in range(d * day, (d + 1) * day, step) if first <= t < end]
    assert sorted(tuple(r) for r in got) == [(s, t) for s in "ab" for t in want]


def test_steps_of_more_than_a_day_are_refused(spark):
    with pytest.raises(ValueError):
        symbol_grid(spark.createDataFrame([("a",)], "symbol string"), 0, 10**9, 86_400_001)


@pytest.mark.parametrize("seconds", [420, 660, 1000])
def test_every_bucket_finds_its_place_on_the_grid(spark, seconds):
    """Also where the length doesn't divide a day."""
    week = spark.range(0, 7 * 86_400_000, 59_000).select(bucket_ms(F.col("id"), seconds).alias("t")).distinct()
    series = week.select(F.lit("a").alias("symbol"), "t", F.lit(1.0).alias("r"))
    grid = on_grid(series, "t", 0, 7 * 86_400_000, seconds * 1000)
    assert grid.where("r is not null").count() == series.count() == grid.count()
    starts = {r.start for r in time_grid(spark, "1970-01-01", "1970-01-08", 7).collect()}
    if seconds == 420:
        assert starts == {r.t for r in series.collect()}


def test_fill(spark):
    nan = float("nan")
    series = spark.createDataFrame([("a", 0, 1.0, 3.0), ("a", 2, nan, 5.0), ("b", 1, 2.0, 7.0)], "symbol string, t long, r double, p double")
    grid = on_grid(series, "t", 0, 3, 1)
    filled = fill_with_symbol_mean(zero_fill(grid, ["r"]), "p", series)
    assert sorted(tuple(r) for r in filled.collect()) == [
        ("a", 0, 1.0, 3.0), ("a", 1, 0.0, 4.0), ("a", 2, 0.0, 5.0), ("b", 0, 0.0, 7.0), ("b", 1, 2.0, 7.0), ("b", 2, 0.0, 7.0),
    ]


@pytest.mark.parametrize("samples", [None, 3, 7, 100])
def test_stride_sample(spark, samples):
    hours = [dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(hours=7 * i) for i in range(40)]
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate(hours)], "symbol string, x timestamp, i int")
    got = sorted(r.i for r in stride_sample(df, "x", samples).collect())
    step = 40 // samples if samples and samples < 40 else 1
    assert got == list(range(40))[::step]
