import math

from tickloom.operators.bars import open_close_bars
from tickloom.plans.trades import daily_average_price, trades_arbitrage
from tickloom.sources.schemas import ARBITRAGE, TRADES

DAY = 1_704_067_200_000


def trade(exchange, offset, price, amount, sell, symbol="btcusd", day=DAY):
    return (f"{exchange}{offset}", exchange, symbol, day + offset, price, amount, sell)


def bars(spark, rows, **kw):
    return trades_arbitrage(spark.createDataFrame(rows, TRADES), 1, **kw).orderBy("start_second").collect()


def test_arbitrage_between_exchanges(spark):
    rows = [
        trade("x", 1, 100.0, 2.0, True), trade("x", 2, 101.0, 1.0, False),
        trade("y", 3, 104.0, 3.0, True), trade("y", 4, 106.0, 4.0, False),
        trade("x", 1000, 100.0, 1.0, True), trade("x", 1001, 105.0, 1.0, False),
    ]
    first, second = bars(spark, rows)
    assert (first.min_price_trades_ask, first.exchange_of_min_price_trades_ask) == (100.0, "x")
    assert (first.max_price_trades_bid, first.exchange_of_max_price_trades_bid) == (106.0, "y")
    assert first.arbitrage_spread == 6.0
    assert first.arbitrage_profit == 6.0 * 2.0
    assert (first.order_flow_of_min_price_trades_ask, first.order_flow_of_max_price_trades_bid) == (-1.0, 1.0)
    assert (first.total_number_of_trades, first.total_volume, first.total_order_flow) == (4, 10.0, 0.0)
    # the gap on a single exchange is no arbitrage
    assert second.max_price_trades_bid - second.min_price_trades_ask == 5.0
    assert (second.arbitrage_spread, second.arbitrage_profit) == (0.0, 0.0)


def test_one_sided_exchange_makes_best_bid_nan(spark):
    rows = [trade("x", 1, 100.0, 2.0, True), trade("y", 2, 103.0, 1.0, False), trade("y", 3, 99.0, 1.0, True)]
    bar = bars(spark, rows)[0]
    assert math.isnan(bar.max_price_trades_bid)
    assert bar.exchange_of_max_price_trades_bid == "y"
    assert bar.arbitrage_spread == 0.0
    assert bar.min_price_trades_ask == 99.0
    bar = bars(spark, rows, nan_policy="ignore")[0]
    assert bar.max_price_trades_bid == 103.0


def test_zero_volume_exchange_poisons_the_average(spark):
    bar = bars(spark, [trade("x", 1, 100.0, 0.0, False), trade("y", 1, 101.0, 5.0, True)])[0]
    assert math.isnan(bar.avg_price)
    assert bar.total_volume == 5.0


def test_no_sells_at_all(spark):
    bar = bars(spark, [trade("x", 1, 100.0, 1.0, False)])[0]
    assert math.isnan(bar.min_price_trades_ask)
    assert bar.exchange_of_min_price_trades_ask == ""
    assert bar.volume_of_min_price_trades_ask == 0.0


def test_equal_best_prices_go_to_the_smallest_name(spark):
    rows = [trade(e, 1, 100.0, 1.0, s) for e in ("z", "b", "m") for s in (True, False)]
    bar = bars(spark, rows)[0]
    assert (bar.exchange_of_min_price_trades_ask, bar.exchange_of_max_price_trades_bid) == ("b", "b")


def test_range_is_inclusive_at_both_ends(spark):
    rows = [trade("x", t, 1.0, 1.0, True) for t in (-1, 0, 86_400_000, 86_400_001)]
    assert len(bars(spark, rows, first_day="2024-01-01", last_day="2024-01-02")) == 2


def test_output_schema(spark):
    frame = trades_arbitrage(spark.createDataFrame([trade("x", 1, 1.0, 1.0, True)], TRADES), 1)
    assert [(f.name, f.dataType) for f in frame.schema] == [(f.name, f.dataType) for f in ARBITRAGE]


def test_daily_price(spark):
    rows = [trade("x", 1, 10.0, 1.0, True), trade("y", 86_399_999, 20.0, 3.0, False), trade("y", 86_400_000, 7.0, 1.0, True)]
    got = daily_average_price(spark.createDataFrame(rows, TRADES)).orderBy("day").collect()
    assert [tuple(r) for r in got] == [("2024-01-01", "btcusd", 2, 4.0, 17.5), ("2024-01-02", "btcusd", 1, 1.0, 7.0)]


def test_open_close(spark):
    rows = [trade("x", 5, 10.0, 1.0, True), trade("x", 9, 12.0, 1.0, True), trade("y", 1, 11.0, 1.0, True), trade("y", 7, 8.0, 1.0, True)]
    bar = open_close_bars(spark.createDataFrame(rows, TRADES), 1).first()
    assert (bar.price_open, bar.price_close) == (11.0, 12.0)
    assert bar.range_return == (12.0 - 10.0) / 10.0


def test_equal_trades_in_another_order_have_equal_prices(spark):
    prices = [0.1, 0.2, 0.3]
    rows = [trade("x", i, p, 1.0, True) for i, p in enumerate(prices)] + [trade("x", 3, 0.5, 1.0, False)]
    rows += [trade("y", i + 4, p, 1.0, True) for i, p in enumerate(reversed(prices))] + [trade("y", 7, 0.9, 1.0, False)]
    (bar,) = trades_arbitrage(spark.createDataFrame(rows, TRADES).coalesce(1), 1).collect()
    # summed as they come, the trades of "y" are cheaper by one bit, and the spread to its own bid is lost
    assert (bar.exchange_of_min_price_trades_ask, bar.exchange_of_max_price_trades_bid) == ("x", "y")
    assert bar.arbitrage_spread == 0.9 - math.fsum(prices) / 3


def test_exact_sum_in_any_order(spark):
    from pyspark.sql import functions as F

    from tickloom.functions.measures import exact_sum

    values = [0.1 * k * 10.0 ** (k % 9 - 4) * (-1) ** k for k in range(1, 200)]
    odd = [(1, math.inf), (1, 1.0), (2, math.nan), (2, 1.0), (3, None), (4, None), (4, 0.1), (5, 1e30), (5, 1.0)]
    for rows in (values, values[::-1], sorted(values)):
        df = spark.createDataFrame([(0, v) for v in rows] + odd, "k int, v double")
        got = {r.k: r.s for r in df.groupBy("k").agg(exact_sum(F.col("v")).alias("s")).collect()}
        assert got[0] == math.fsum(values)
        assert (got[1], got[3], got[4], got[5]) == (math.inf, None, 0.1, 1e30) and math.isnan(got[2])
