import math

import pytest
from pyspark.sql import functions as F

from tickloom.functions import measures as m

NAN = float("nan")


def agg(spark, rows, schema, column):
    return spark.createDataFrame(rows, schema).agg(column.alias("v")).first().v


def test_vwap_counts_null_as_zero_and_is_nan_without_volume(spark):
    schema = "price double, amount double, sell boolean"
    price, amount, sell = F.col("price"), F.col("amount"), m.is_sell(F.col("sell"))
    rows = [(10.0, 1.0, True), (None, 1.0, False), (40.0, 2.0, None)]
    assert agg(spark, rows, schema, m.vwap(price, amount)) == 90 / 4
    assert agg(spark, rows, schema, m.vwap(price, amount, sell)) == 10.0
    assert agg(spark, rows, schema, m.vwap(price, amount, ~sell)) == 80 / 3
    assert math.isnan(agg(spark, [(10.0, 0.0, True)], schema, m.vwap(price, amount)))
    assert math.isnan(agg(spark, [(10.0, 1.0, False)], schema, m.vwap(price, amount, sell)))
    assert agg(spark, rows, schema, m.order_flow(F.col("sell"), amount)) == 2.0
    assert agg(spark, rows, schema, m.volume(amount, sell)) == 1.0
    assert agg(spark, [], schema, m.volume(amount)) == 0.0


def test_picks_skip_nan_and_break_ties_on_the_name(spark):
    schema = "exchange string, price double"
    name, price = F.col("exchange"), F.col("price")
    rows = [("c", NAN), ("b", 2.0), ("a", 2.0), ("d", 5.0), ("e", 5.0), ("f", -1.0)]
    assert agg(spark, rows[:5], schema, m.at_lowest(name, price, name, "")) == "a"
    assert agg(spark, rows, schema, m.at_highest(name, price, name, "")) == "d"
    assert agg(spark, [("c", NAN)], schema, m.at_lowest(name, price, name, "")) == ""
    assert agg(spark, [("c", NAN), ("f", -1.0)], schema, m.at_highest(name, price, name, "")) == ""


def test_returns(spark):
    schema = "p double, t long"
    p, t = F.col("p"), F.col("t")
    rows = [(12.0, 3), (10.0, 1), (99.0, 2)]
    assert agg(spark, rows, schema, m.log_return(p, t)) == pytest.approx(math.log(1.2))
    assert agg(spark, rows, schema, m.simple_return(p, t)) == pytest.approx(0.2)
    assert agg(spark, [(0.0, 2), (10.0, 1)], schema, m.log_return(p, t)) == -math.inf
    assert agg(spark, [(5.0, 2), (0.0, 1)], schema, m.log_return(p, t)) == math.inf
    assert agg(spark, [(5.0, 2), (0.0, 1)], schema, m.simple_return(p, t)) == math.inf
    assert math.isnan(agg(spark, [(0.0, 1)], schema, m.simple_return(p, t)))
    assert math.isnan(agg(spark, [(-5.0, 2), (5.0, 1)], schema, m.log_return(p, t)))
    assert agg(spark, rows, schema, m.range_return(p, p)) == pytest.approx(8.9)


def test_conditional_measures(spark):
    c = F.col("c")
    rows = [(NAN,), (None,), (-1.0,), (0.0,), (2.0,), (4.0,)]
    assert agg(spark, rows, "c double", m.avg_if_positive(c)) == 3.0
    assert agg(spark, rows, "c double", m.count_if_positive(c)) == 2
    assert agg(spark, rows, "c double", m.fraction_of_zeros(c)) == pytest.approx(2 / 6)
    assert agg(spark, rows[1:], "c double", m.avg_if_not_null(c)) == 1.25
    assert agg(spark, [(3.0,), (None,), (4.0,)], "c double", m.realized_volatility(c)) == 5.0
    for measure in (m.avg_if_positive(c), m.avg_if_not_null(c), m.fraction_of_zeros(c), m.realized_variance(c)):
        assert agg(spark, [], "c double", measure) == 0.0


def test_constant_of(spark):
    assert agg(spark, [("a",), ("a",)], "c string", m.constant_of(F.col("c"), "c")) == "a"
    with pytest.raises(Exception, match="c differs within a group"):
        agg(spark, [("a",), ("b",)], "c string", m.constant_of(F.col("c"), "c"))


def test_aggregate_by_name(spark):
    rows = [(1.0,), (3.0,)]
    got = [agg(spark, rows, "c double", m.aggregate_by_name(n, "c")) for n in ("avg", "max", "min", "sum", "count")]
    assert got == [2.0, 3.0, 1.0, 4.0, 2]
    with pytest.raises(ValueError):
        m.aggregate_by_name("median", "c")
