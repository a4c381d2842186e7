import datetime as dt
import math

from tickloom.operators.triangle import Triangle
from tickloom.plans.triangulation import triangulation, triangulation_monthly

NAN = float("nan")
T = Triangle("btcusdt", "btcusd", "usdtusd")
U = Triangle("ethusdt", "ethusd", "usdtusd")
SCHEMA = (
    "start_second timestamp, symbol string, avg_price double, min_price_trades_ask double, max_price_trades_bid double, "
    "volume_of_min_price_trades_ask double, volume_of_max_price_trades_bid double, total_volume double"
)


def at(second):
    return dt.datetime(2024, 1, 1, 0, 0, second, tzinfo=dt.timezone.utc)


def rows(second, cs=(100.0, 99.0), cu=(103.0, 104.0), su=(1.01, 1.0), volumes=(2.0, 3.0, 150.0)):
    """(ask, bid) per leg"""
    out = []
    for (symbol, (ask, bid)), v in zip((("btcusdt", cs), ("btcusd", cu), ("usdtusd", su)), volumes):
        out.append((at(second), symbol, 100.0 if symbol != "usdtusd" else 1.0, ask, bid, v, v, v * 10))
    return out


def run(spark, data, triangles=(T,)):
    return triangulation(spark.createDataFrame(data, SCHEMA), list(triangles))


def test_sell_spread_volume_and_profit(spark):
    row = run(spark, rows(1)).first()
    assert row.symbol == "btcusdt-btcusd-usdtusd"
    assert math.isclose(row.sell_arbitrage_spread, 104 / 100 - 1.01)
    assert row.buy_arbitrage_spread == 0.0
    assert row.sell_volume == min(2 * 100, 3 * 100, 150)
    assert math.isclose(row.sell_arbitrage_profit, (1.04 - 1.01) * 150)
    assert math.isclose(row.sell_arbitrage_spread_bips, 10_000 * (1.04 - 1.01) / 1.0)
    assert row.total_volume == min(20 * 100, 30 * 100, 1500)


def test_buy_spread(spark):
    row = run(spark, rows(1, cs=(101.0, 100.0), cu=(98.0, 97.0), su=(1.01, 1.0))).first()
    assert math.isclose(row.buy_arbitrage_spread, 1.0 - 98 / 100)
    assert row.sell_arbitrage_spread == 0.0


def test_missing_legs_and_nan_prices_give_zero(spark):
    incomplete = rows(1)[:2]
    nan_leg = rows(2, cu=(NAN, NAN))
    zero_volume = rows(3, volumes=(0.0, 3.0, 150.0))
    got = {r.start_second.second: r for r in run(spark, incomplete + nan_leg + zero_volume).collect()}
    assert (got[1].sell_arbitrage_spread, got[1].sell_volume, got[1].avg_stable_usd_price) == (0.0, 0.0, 0.0)
    assert (got[2].sell_arbitrage_spread, got[2].buy_arbitrage_spread) == (0.0, 0.0)
    assert (got[3].sell_volume, got[3].total_volume, got[3].sell_arbitrage_profit) == (0.0, 0.0, 0.0)


def test_many_triangles_share_a_leg(spark):
    eth = [(t, s.replace("btc", "eth"), *rest) for t, s, *rest in rows(1)[:2]]
    got = run(spark, rows(1) + eth, (T, U)).collect()
    assert sorted(r.symbol for r in got) == [T.symbol, U.symbol]
    assert got[0].sell_arbitrage_spread == got[1].sell_arbitrage_spread > 0


def test_monthly(spark):
    series = run(spark, rows(1) + rows(2) + rows(59)[:2])
    row = triangulation_monthly(series).first()
    assert row.number_of_seconds_sell_arbitrage_spread_positive == 2
    assert math.isclose(row.sell_arbitrage_profit_in_usd, 2 * 0.03 * 150)
    assert math.isclose(row.average_sell_arbitrage_spread_bips, 300.0)
    assert math.isclose(row.avg_price, 1.0)
