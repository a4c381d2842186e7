import pytest

from tickloom.operators.rates import PairRates, check_pairs, join_base_rate, join_quote_rate
from tickloom.functions.spreads import in_usd


def test_contracts():
    check_pairs([PairRates("btcusdt", "usdtusd", "btcusd")])
    with pytest.raises(ValueError, match="not a USD rate"):
        check_pairs([PairRates("btcusdt", "usdteur", "btcusd")])
    with pytest.raises(ValueError, match="incompatible"):
        check_pairs([PairRates("btcusdt", "daiusd", "btcusd")])


def test_conversion(spark):
    pairs = [PairRates("btcusdt", "usdtusd", "btcusd"), PairRates("usdtusd", "usdusd", "usdtusd")]
    rates = spark.createDataFrame(
        [("d1", "usdtusd", 1.02), ("d1", "btcusd", 100.0), ("d2", "btcusd", 90.0)], "day string, symbol string, average_daily_price double"
    )
    df = spark.createDataFrame([("d1", "btcusdt", 2.0), ("d2", "btcusdt", 2.0)], "day string, symbol string, v double")
    out = join_base_rate(join_quote_rate(df, rates, pairs), rates, pairs)
    got = out.select("day", "usd_rate", in_usd("v", "usd_rate_average_daily_price"), in_usd("v", "usd_rate_base_ccy_average_daily_price"))
    assert sorted(tuple(r) for r in got.collect()) == [("d1", "usdtusd", 2.04, 200.0), ("d2", None, 2.0, 180.0)]


def test_unknown_symbol_fails(spark):
    rates = spark.createDataFrame([("d1", "btcusd", 1.0)], "day string, symbol string, average_daily_price double")
    df = spark.createDataFrame([("d1", "ethdai", 2.0)], "day string, symbol string, v double")
    with pytest.raises(Exception, match="no USD rate given for ethdai"):
        join_quote_rate(df, rates, [PairRates("btcusd", "usdusd", "btcusd")]).collect()
