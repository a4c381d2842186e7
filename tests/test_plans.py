import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tickloom.operators.rates import PairRates
from tickloom.plans import intraday, monthly, order_book, reports, zero_fill
from tickloom.session import shared_dir, stage

NAN = float("nan")
UTC = dt.timezone.utc
START = dt.datetime(2024, 1, 1, tzinfo=UTC)
BARS = (
    "start_second timestamp, symbol string, total_number_of_trades long, avg_price double, total_volume double, "
    "min_price_trades_ask double, max_price_trades_bid double, total_order_flow double, arbitrage_spread double, "
    "arbitrage_profit double"
)


def bar(second, price, symbol="btcusd", trades=1, volume=2.0, spread=0.0, profit=0.0, flow=1.0):
    return (START + dt.timedelta(seconds=second), symbol, trades, price, volume, price, price + spread, flow, spread, profit)


def frame(spark, rows):
    return spark.createDataFrame(rows, BARS)


def rates(spark, *rows):
    return spark.createDataFrame(list(rows), "day string, symbol string, average_daily_price double")


def test_minute_returns_and_monthly_volatility(spark):
    rows = [bar(0, 100.0), bar(59, 110.0), bar(60, 100.0), bar(70, 90.0), bar(120, 100.0), bar(121, 300.0), bar(125, NAN)]
    returns = monthly.minute_returns(frame(spark, rows), F.lit(True))
    got = sorted(r["return"] for r in returns.collect())
    assert got == [pytest.approx(math.log(0.9)), pytest.approx(math.log(1.1))]  # ln 3 exceeds one half
    row = monthly.monthly_volatility(returns).first()
    dev = abs(got[1] - got[0]) / math.sqrt(2)
    assert row.volatility_minute_returns == pytest.approx(dev)
    assert row.volatility_minute_returns_monthly == pytest.approx(dev * math.sqrt(43_200))


def test_monthly_measures_use_the_rates(spark):
    rows = [bar(0, 10.0, "btcusdt", 3, 2.0, 1.0, 5.0), bar(60, 12.0, "btcusdt", 1, 4.0), bar(86_400, NAN, "btcusdt", 2, 1.0, 0.0, 1.0)]
    table = rates(spark, ("2024-01-01", "usdtusd", 1.1), ("2024-01-01", "btcusd", 100.0), ("2024-01-02", "btcusd", 200.0))
    row = monthly.monthly_measures(frame(spark, rows), table, [PairRates("btcusdt", "usdtusd", "btcusd")]).first()
    assert row.arbitrage_profit_in_usd == pytest.approx(5 * 1.1 + 1)  # no rate on the second day: taken as 1
    assert row.total_volume_in_usd == pytest.approx(6 * 100 + 200)
    assert row.usd_rate_average_price == pytest.approx(1.1)
    assert (row.total_number_of_trades, row.avg_price) == (4, 11.0)  # the NaN bar does not spoil the month
    assert row.number_of_seconds_arbitrage_spread_positive == 1
    assert row.average_arbitrage_spread_bips == pytest.approx(10_000 * 1.0 / 10.5)


def test_monthly_usd_pair_is_limited_to_dollar_pairs(spark):
    rows = [bar(0, 10.0, profit=2.0), bar(60, 10.0), bar(0, 10.0, "btcusdt"), bar(60, 10.0, "btcusdt")]
    table = rates(spark, ("2024-01-01", "btcusd", 100.0), ("2024-01-09", "btcusd", 300.0))
    (row,) = monthly.monthly_measures_usd_pair(frame(spark, rows), table).collect()
    assert (row.symbol, row.arbitrage_profit_in_usd, row.total_volume_in_usd) == ("btcusd", 2.0, 400.0)
    assert row.usd_rate_average_price == 200.0


def test_zero_fill_and_realized_volatility(spark):
    # a bucket of one bar has no deviation and is dropped; its place on the grid is filled
    rows = [bar(0, 100.0), bar(10, 101.0), bar(310, 50.0), bar(600, 100.0), bar(610, 98.0)]
    series = stage(zero_fill.return_series(frame(spark, rows), 300), "series")
    assert series.count() == 2
    filled = zero_fill.zero_filled_series(series, "2024-01-01", "2024-01-02", 300).orderBy("start").collect()
    assert len(filled) == 288
    assert [r.logreturn for r in filled[:4]] == [pytest.approx(0.01), 0.0, pytest.approx(-0.02), 0.0]
    assert filled[0]["return"] == pytest.approx(math.log(1.01))
    assert filled[1].avg_price == pytest.approx((100.5 + 99.0) / 2)
    day = zero_fill.daily_volatility(zero_fill.zero_filled_series(series, "2024-01-01", "2024-01-02", 300)).first()
    vol = math.sqrt(0.01**2 + 0.02**2)
    assert day.daily_volatility_logreturns == pytest.approx(vol)
    assert day.annualized_daily_volatility_logreturns == pytest.approx(vol * math.sqrt(365))


def test_intraday_breakdown(spark):
    rows = [bar(0, 100.0, volume=3.0, spread=2.0, profit=1.0), bar(301, 100.0, volume=1.0), bar(3600, 102.0, volume=4.0)]
    pairs = [PairRates("btcusd", "usdusd", "btcusd")]
    table = rates(spark, ("2024-01-01", "btcusd", 10.0))
    bins = intraday.filled_bins(frame(spark, rows), table, pairs, "2024-01-01", "2024-01-02")
    assert bins.count() == 288
    got = {r.start_minute_of_day: r for r in intraday.intraday_breakdown(bins).collect()}
    assert len(got) == 24
    assert got[0].total_volume_in_usd == pytest.approx(40.0)
    assert got[0].avg_total_volume_in_usd_as_daily_percentage == pytest.approx(0.5)
    assert got[0].avg_arbitrage_profit_in_usd_as_daily_percentage == 1.0
    assert got[0].avg_arbitrage_spread_as_midpoint_bips == pytest.approx(10_000 * 2 / 101 / 2)
    # an hour without data: zero activity, and zero for the averages that were never defined
    assert (got[120].total_volume_in_usd, got[120].avg_price_parity) == (0.0, 0.0)
    shares = intraday.intraday_variance(bins)
    assert shares.agg(F.sum("variance_logreturns")).first()[0] == 0.0  # one bar per bin, no returns


def test_intraday_variance_shares_sum_to_one(spark):
    rows = [bar(s, p) for s, p in ((0, 100.0), (5, 101.0), (4000, 100.0), (4001, 97.0))]
    bins = intraday.filled_bins(
        frame(spark, rows), rates(spark, ("2024-01-01", "btcusd", 10.0)), [PairRates("btcusd", "usdusd", "btcusd")],
        "2024-01-01", "2024-01-02",
    )
    got = {r.start_minute_of_day: r for r in intraday.intraday_variance(bins).collect()}
    assert got[0].avg_variance_logreturns_as_daily_percentage == pytest.approx(0.01**2 / (0.01**2 + 0.03**2))
    assert got[60].variance_logreturns == pytest.approx(0.03**2)


def test_book_breakdown_averages_empty_hours_as_zero(spark):
    start = int(START.timestamp()) * 1000
    rows = [(start + 60_000 * i, "btcusd", 2.0, 1.0, 100.0) for i in range(10)]
    series = spark.createDataFrame(rows, "start_ts_ob long, symbol string, effective_spread_ob double, bid_ask_spread double, midpoint_ob double")
    pick = lambda **kw: {
        r.start_minute_of_day: (r.effective_spread_as_bps, r.bid_ask_spread_as_bps)
        for r in order_book.book_intraday_breakdown(series, "2024-01-01", "2024-01-03", **kw).collect()
    }
    assert len(pick()) == 24
    assert pick()[0] == (pytest.approx(100.0), pytest.approx(50.0))  # the second day's empty hour counts
    assert pick(skip_empty=True)[0] == (pytest.approx(200.0), pytest.approx(100.0))


def test_monthly_pivot_and_duplicates(spark):
    rows = [("a", "2024-01", 2.0), ("a", "2024-02", None), ("b", "2024-02", 5.0)]
    df = spark.createDataFrame(rows, "symbol string, year_month string, v double")
    table = {r.symbol: r for r in reports.monthly_pivot(df, "v", ["2024-01", "2024-02", "2024-03"], 10.0).collect()}
    assert tuple(table["a"]) == ("a", 20.0, None, None)
    assert tuple(table["b"]) == ("b", None, 50.0, None)
    with pytest.raises(Exception, match="more than one row"):
        reports.monthly_pivot(df.union(df), "v", ["2024-01"]).collect()


def test_arbitrage_summary(spark):
    rows = [("a", 100.0, 10, 50.0), ("a", 50.0, 30, 10.0), ("a", 1.0, None, 7.0), ("b", 10.0, 5, 15.0)]
    schema = (
        "symbol string, arbitrage_profit_in_usd double, number_of_seconds_arbitrage_spread_positive long, "
        "average_arbitrage_spread_bips double"
    )
    got = {r.symbol: r for r in reports.arbitrage_summary(spark.createDataFrame(rows, schema)).collect()}
    assert (got["a"].profits, got["a"].opportunities, got["a"].spread) == (151.0, 40, 20.0)
    assert got["a"].net_profits == pytest.approx(0.0)  # 20 bips is exactly the two fees
    assert got["b"].net_profits == 0.0
    rich = spark.createDataFrame([("a", 100.0, 10, 50.0)], schema)
    assert reports.arbitrage_summary(rich).first().net_profits == pytest.approx(100 / 0.005 * 0.003)


def test_statistics_report_and_order(spark):
    values = {"mean": 1.0, "stddev": 1.0, "percentage_of_zeros": 0.5}
    rows = [(*values.values(), t, s) for t in ("avg_price", "total_number_of_trades", "other") for s in ("usdtusd", "btcusdt", "xxx")]
    df = spark.createDataFrame(rows + rows[:1], "mean double, stddev double, percentage_of_zeros double, type string, symbol string")
    got = reports.statistics_report(df).orderBy("type", "position").collect()
    assert [(r.type, r.symbol) for r in got] == [
        ("avg_price", "btcusdt"), ("avg_price", "usdtusd"), ("total_number_of_trades", "btcusdt"), ("total_number_of_trades", "usdtusd"),
    ]
    assert [r.percentage_of_zeros for r in got] == [None, None, 0.5, 0.5]


def test_correlation_matrix_triangles(spark):
    schema = "measure string, first string, second string, correlation double, significance double"
    fast = spark.createDataFrame([("m", "a", "b", 0.5, 0.01), ("m", "c", "a", 0.05, 0.2), ("m", "b", "c", -0.4, 0.03)], schema)
    slow = spark.createDataFrame([("m", "b", "a", 0.9, 0.001), ("m", "a", "c", 0.2, 0.6), ("m", "b", "c", 0.3, 0.04)], schema)
    matrix = reports.correlation_matrix(fast, slow, ["a", "b", "c"], ["measure"], threshold=0.1, significance_threshold=0.05)
    table = {r.entity: r for r in reports.matrix_table(matrix, ["measure"], ["a", "b", "c"]).collect()}
    assert tuple(table["a"])[2:] == (1.0, 0.5, None)
    assert tuple(table["b"])[2:] == (0.9, 1.0, -0.4)
    assert tuple(table["c"])[2:] == (0.2, 0.3, 1.0)
    p = {r.entity: r for r in reports.matrix_table(matrix, ["measure"], ["a", "b", "c"], "significance").collect()}
    assert tuple(p["a"])[2:] == (0.0, 0.01, None)
    assert tuple(p["c"])[2:] == (None, 0.04, 0.0)


def test_parity_table_and_points(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 90, 3.0)], "symbol string, start_minute_of_day int, avg_price_parity double")
    assert tuple(reports.parity_table(df).first()) == ("a", 1.0, 3.0, pytest.approx(math.sqrt(2)))
    points = sorted(tuple(r) for r in reports.breakdown_points(df, ["avg_price_parity"]).collect())
    assert points == [("a", 0.0, "avg_price_parity", 1.0), ("a", 1.5, "avg_price_parity", 3.0)]


def test_plot_series(spark):
    rows = [bar(86_400 * d + h * 3600, 1.0 + d, volume=1.0) for d in range(6) for h in range(3)]
    days = reports.plot_series(frame(spark, rows), "total_volume", "sum", 3).orderBy("x").collect()
    assert [(r.x.day, r.y) for r in days] == [(1, 3.0), (3, 3.0), (5, 3.0)]
    assert reports.plot_series(frame(spark, rows), "avg_price", None, None).count() == 18


def test_stage_uses_the_configured_folder(spark):
    staged = stage(spark.range(3), "demo")
    assert shared_dir(spark).removeprefix("file:").rstrip("/") in staged.inputFiles()[0]
    assert staged.dtypes == spark.range(3).dtypes
    assert sorted(r.id for r in staged.collect()) == [0, 1, 2]
