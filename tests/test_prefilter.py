import random
import re

import pytest

from tickloom.operators import book as ob
from tickloom.operators.prefilter import LEAST_BITS, MOST_BITS, bitmap, bitmap_bits, likely_in
from tickloom.session import stage


def test_sizes():
    assert (bitmap_bits(0), bitmap_bits(1), bitmap_bits(10**12)) == (LEAST_BITS, LEAST_BITS, MOST_BITS)
    assert bitmap_bits(1_000) == 1 << 14 and bitmap_bits(1 << 10) == 1 << 14 and bitmap_bits((1 << 10) + 1) == 1 << 15


def test_all_partners_pass_and_few_others(spark):
    rows = spark.range(50_000).selectExpr("concat('s', id % 7) as symbol", "id as date")
    keys = stage(rows.where("date % 50 = 3"), "keys")
    kept = likely_in(rows, keys, ["symbol", "date"])
    assert kept.join(keys, ["symbol", "date"]).count() == keys.count() == 1_000
    assert 1_000 <= kept.count() < 1_000 + 49_000 / 30
    assert bitmap(keys, ["symbol", "date"], 1 << 14).selectExpr("size(bitmap) as n").first().n == 256


def test_odd_keys(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), (None, 1), (None, None), ("b", -5)], "symbol string, date long")
    none = stage(rows.limit(0), "none")
    assert likely_in(rows, none, ["symbol", "date"]).count() == 0
    assert likely_in(rows, stage(rows, "all"), ["symbol", "date"]).count() == 5


def test_keys_of_another_type(spark):
    rows = spark.range(2_000).selectExpr("cast(id as int) as n")
    keys = stage(spark.range(5).selectExpr("id * 7 as n"), "keys")
    assert {0, 7, 14, 21, 28} <= {r.n for r in likely_in(rows, keys, ["n"]).collect()}


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, value in before.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def test_the_book_is_filtered_before_its_exchange(spark, no_broadcast):
    rng = random.Random(4)
    quotes = [("s%d" % (t % 3), 10_000 * (t // 40), rng.choice("ab"), rng.random(), 1.0) for t in range(20_000)]
    book = stage(spark.createDataFrame(quotes, "symbol string, date long, type string, price double, amount double"), "book")
    times = stage(ob.snapshot_times(book, 300), "times")
    levels = ob.snapshot_levels(book, times)
    found = levels.collect()
    plan = levels._jdf.queryExecution().executedPlan().toString()
    # the branch of the join that reads prices: a scan, the filter, then the exchange by symbol and date
    branch = re.search(r"SortMergeJoin.*?Exchange hashpartitioning\(symbol.*?\n(.*?)FileScan[^\n]*price", plan, re.DOTALL).group(1)
    assert "Filter" in branch and "subquery" in branch and "Exchange hashpartitioning(symbol" not in branch
    moved = re.findall(r"Exchange hashpartitioning\(symbol#\d+, date", plan)
    assert moved
    wanted = {(r.symbol, r.date): r.start_ts for r in times.collect()}
    want = {}
    for symbol, date, kind, price, amount in quotes:
        if (symbol, date) in wanted:
            key = (symbol, wanted[symbol, date], kind == "b", price)
            want[key] = want.get(key, 0.0) + amount
    assert {(r.symbol, r.start_ts, r.bid, r.price): r.amount for r in found} == want
