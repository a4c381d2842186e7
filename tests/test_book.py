import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import book as ob

SCHEMA = "symbol string, date long, type string, price double, amount double"


def price_by_hand(quotes, quantity, bid):
    """The definition, literally: prefix sums below the quantity decide how many quotes are touched."""
    ordered = sorted(quotes, key=lambda q: (-q[0] if bid else q[0], q[1]))
    sums = [0.0]
    for _, amount in ordered:
        sums.append(sums[-1] + amount)
    below = [s for s in sums if s < quantity]
    touched = ordered[: len(below)]
    return (sum(p * a for p, a in touched[:-1]) + (quantity - below[-1]) * touched[-1][0]) / quantity


def prices(spark, quotes, size, multipliers, **kw):
    book = spark.createDataFrame([("s", d, t, float(p), float(a)) for t, p, a, d in quotes], SCHEMA)
    times = ob.snapshot_times(book, 60)
    levels = ob.banded_levels(ob.snapshot_levels(book, times))
    sizes = times.select("symbol", "start_ts", F.lit(size).cast("double").alias("size"))
    return levels, sizes, ob.execution_prices(levels, sizes, multipliers, **kw)


def test_spread_and_midpoint_use_the_earliest_snapshot(spark):
    quotes = [("a", 20, 1, 0), ("a", 18, 1, 1), ("b", 15, 1, 1), ("b", 10, 1, 0)]
    levels, _, _ = prices(spark, quotes, 1, [1.0])
    top = ob.top_of_book(levels).first()
    assert (top.bid_ask_spread, top.midpoint_ob) == (10.0, 15.0)


def test_spread(spark):
    levels, _, _ = prices(spark, [("b", 15, 1, 0), ("b", 10, 1, 0), ("a", 18, 1, 0), ("a", 20, 1, 0)], 1, [1.0])
    assert ob.top_of_book(levels).first().bid_ask_spread == 3.0


def test_costs(spark):
    quotes = [("a", 20, 200, 0), ("b", 16, 100, 0), ("b", 10, 100, 0)]
    _, _, got = prices(spark, quotes, 10, [1.0, 2.0, 15.0])
    bid = got.where("bid").first()
    assert 18 - bid["execution_price_1"] == 18 - 16
    assert 18 - bid["execution_price_2"] == 18 - 16
    assert 18 - bid["execution_price_15"] == pytest.approx(18 - (1600 + 500) / 150)
    quotes = [("a", 23, 200, 0), ("a", 20, 200, 0), ("b", 16, 100, 0), ("b", 10, 100, 0)]
    _, _, got = prices(spark, quotes, 10, [1.0, 2.0, 35.0])
    ask = got.where("not bid").first()
    assert (ask["execution_price_1"] - 18, ask["execution_price_2"] - 18) == (2.0, 2.0)
    assert ask["execution_price_35"] - 18 == pytest.approx((4000 + 3450) / 350 - 18)


def test_thin_book_and_undefined_sizes(spark):
    quotes = [("a", 20, 2, 0), ("a", 21, 3, 0), ("b", 10, 1, 0)]
    _, _, got = prices(spark, quotes, 10, [1.0])
    assert got.where("not bid").first()["execution_price_1"] == pytest.approx((40 + 5 * 21) / 10)
    _, _, got = prices(spark, quotes, 10, [1.0], thin_book="null")
    assert got.where("not bid").first()["execution_price_1"] is None
    for size in (0.0, -1.0, float("nan"), None):
        _, _, got = prices(spark, quotes, size, [1.0])
        assert got.where("not bid").first()["execution_price_1"] is None


def test_one_sided_book_has_no_measures(spark):
    levels, sizes, _ = prices(spark, [("a", 20, 2, 0), ("a", 21, 3, 0)], 1, [1.0])
    row = ob.book_measures(levels, sizes, [1.0]).first()
    assert (row.bid_ask_spread, row.midpoint_ob, row.liquidity_imbalance_1avg) == (None, None, None)


def test_imbalance(spark):
    quotes = [("a", 20, 200, 0), ("b", 16, 100, 0), ("b", 10, 100, 0)]
    levels, sizes, _ = prices(spark, quotes, 10, [15.0])
    row = ob.book_measures(levels, sizes, [15.0]).first()
    buy, sell = 18 - 2100 / 150, 20 - 18
    assert row.liquidity_imbalance_15avg == pytest.approx((buy - sell) / (buy + sell))


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_random_books_against_the_definition(spark, partitions):
    """With many range partitions and no coalescing, sides are cut into several bands."""
    rng = random.Random(7)
    books = {}
    for minute in range(30):
        quotes = [
            (rng.choice("ab"), round(rng.uniform(90, 110), rng.choice([0, 1, 3])), float(rng.randint(1, 30)))
            for _ in range(rng.choice([3, 20, 400]))
        ]
        books[minute * 60_000] = quotes
    rows = [("s", t, *q) for t, quotes in books.items() for q in quotes]
    settings = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        book = spark.createDataFrame(rows, SCHEMA)
        times = ob.snapshot_times(book, 60)
        levels = ob.banded_levels(ob.snapshot_levels(book, times))
        if partitions != "1":
            assert levels.groupBy("start_ts", "bid").agg(F.countDistinct("band").alias("n")).agg(F.max("n")).first()[0] > 1
        sizes = times.select("symbol", "start_ts", F.lit(17.3).alias("size"))
        multipliers = [0.1, 1.0, 3.0, 50.0, 1000.0]
        got = ob.execution_prices(levels, sizes, multipliers).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got
    for row in got:
        quotes = [(p, a) for t, p, a in books[row.start_ts] if (t == "b") == row.bid]
        for k in multipliers:
            assert row[f"execution_price_{k:g}"] == pytest.approx(price_by_hand(quotes, k * 17.3, row.bid)), (row, k)
