import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions.timeexpr import DAY_MS, raster_cells
from tickloom.operators import moments
from tickloom.operators.descriptive import describe
from tickloom.operators.rates import PairRates
from tickloom.plans import monthly, zero_fill
from tickloom.session import stage

FIRST = 1_704_067_200_000


def rows_of(df):
    return {(r["symbol"], r["type"]): [r[c] for c in moments.STATISTICS] for r in df.collect()}


def same(found, want):
    assert found.keys() == want.keys()
    for key, values in want.items():
        assert [x is None for x in found[key]] == [x is None for x in values], key
        known = lambda row: [x for x in row if x is not None]
        assert known(found[key]) == pytest.approx(known(values), rel=1e-7, abs=1e-9, nan_ok=True), key


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(2)
    rows = [("far", rng.randrange(40), 1e6 + rng.gauss(0, 1)) for _ in range(900)] + [("near", rng.randrange(5), rng.gauss(0, 1)) for _ in range(300)]
    rows += [("some", i % 7, None if i % 3 else rng.expovariate(1)) for i in range(90)] + [("flat", i % 7, 0.1) for i in range(77)]
    rows += [("one", 1, 5.0), ("none", 1, None), ("zero", 1, 0.0), ("zero", 2, 0.0)]
    return spark.createDataFrame(rows, "symbol string, part int, x double")


def test_states_merge_to_the_statistics_of_all_rows(values):
    parts = stage(values.groupBy("symbol", "part").agg(*moments.state(F.col("x"), "x")), "parts")
    same(rows_of(moments.statistics(moments.merge(parts, ["symbol"], ["x"]), ["x"])), rows_of(describe(values, ["x"])))


def test_states_of_chosen_rows(values):
    chosen = values.groupBy("symbol").agg(*moments.state(F.col("x"), "x", F.col("part") > 2))
    found = rows_of(moments.statistics(chosen, ["x"]))
    want = rows_of(describe(values.where("part > 2"), ["x"]))
    same({k: v for k, v in found.items() if k in want}, want)


@pytest.mark.parametrize("more", [0, 1, 50, 10_000])
def test_zeros_in_closed_form(spark, values, more):
    known = values.where("x is not null")
    states = known.groupBy("symbol").agg(*moments.state(F.col("x"), "x"))
    found = moments.statistics(moments.with_zeros(states, "x", F.col("x_rows") + more), ["x"])
    zeros = known.select("symbol").distinct().crossJoin(spark.range(more)).selectExpr("symbol", "1 as part", "0.0D as x")
    same(rows_of(found), rows_of(describe(known.union(zeros), ["x"])))


def test_cells_of_a_raster():
    for first, end, step in ((FIRST, FIRST + DAY_MS, 60_000), (FIRST, FIRST + 3 * DAY_MS, 7 * 3_600_000), (FIRST + 5, FIRST + DAY_MS + 9, 3_600_000), (FIRST, FIRST, 1000), (FIRST, FIRST - 5, 1000)):
        starts = [d + k for d in range(FIRST, FIRST + 4 * DAY_MS, DAY_MS) for k in range(0, DAY_MS, step)]
        assert raster_cells(first, end, step) == sum(first <= s < end for s in starts)


@pytest.mark.parametrize("seconds", [3600, 7 * 3600])
def test_zero_filled_figures_without_the_grid(spark, seconds):
    rng = random.Random(6)
    starts = [d + k for d in range(FIRST - DAY_MS, FIRST + 70 * DAY_MS, DAY_MS) for k in range(0, DAY_MS, seconds * 1000)]
    rows = []
    for symbol, share in (("busy", 0.9), ("rare", 0.02), ("full", 1.0)):
        for t in starts:
            if rng.random() < share:
                r = rng.choice([rng.gauss(0, 0.01), None, float("nan"), 0.0]) if symbol == "busy" else rng.gauss(0, 0.01)
                rows.append((t, symbol, r, r, rng.choice([1.0, 2.0, None]), 100 + rng.random()))
    rows.append((FIRST + 1, "rare", 9.0, 9.0, 9.0, 9.0))  # no cell of the grid
    schema = "start_ts long, symbol string, return double, logreturn double, total_number_of_trades double, avg_price double"
    series = stage(spark.createDataFrame(rows, schema), "series")
    first, end = "2024-01-01", "2024-03-08"
    on_raster = series.where(f"start_ts <> {FIRST + 1}")
    filled = stage(zero_fill.zero_filled_series(on_raster, first, end, seconds), "filled")
    inside = on_raster.where((F.col("start_ts") >= FIRST) & (F.col("start_ts") < FIRST + 67 * DAY_MS))
    sparse = zero_fill.sparse_statistics(series, first, end, seconds)
    same(rows_of(sparse), rows_of(zero_fill.zero_filled_statistics(inside, filled)))
    assert "Join" not in sparse._jdf.queryExecution().optimizedPlan().toString()
    months = lambda df: {(r["year_month"], r["symbol"]): (r[2], r[3]) for r in df.select("year_month", "symbol", "monthly_volatility_logreturns", "annualized_monthly_volatility_logreturns").collect()}
    found, want = months(zero_fill.sparse_monthly_volatility(series, first, end, seconds)), months(zero_fill.monthly_volatility(filled))
    assert found.keys() == want.keys()
    for key, pair in want.items():
        assert found[key] == pytest.approx(pair)


def bars(spark, rng):
    rows = []
    for i in range(6_000):
        symbol = rng.choice(["btcusd", "btcusdt", "usdtusd"])
        price = rng.choice([float("nan"), 50_000 + rng.gauss(0, 3)]) if rng.random() < 0.1 else 50_000 + rng.gauss(0, 3)
        spread = max(rng.gauss(-1, 2), 0.0)
        rows.append((1_704_067_200 + rng.randrange(60 * 86_400), symbol, i % 4, price, rng.random(), price - 1, price + 1, spread, spread * 0.1))
    schema = "second long, symbol string, total_number_of_trades long, avg_price double, total_volume double, min_price_trades_ask double, max_price_trades_bid double, arbitrage_spread double, arbitrage_profit double"
    return stage(spark.createDataFrame(rows, schema).withColumn("start_second", F.timestamp_seconds("second")).drop("second"), "bars")


def test_months_are_rolled_up_from_one_scan_of_the_bars(spark):
    table = bars(spark, random.Random(3))
    rates = spark.createDataFrame([(f"2024-0{m}-{d:02d}", s, 1.0 + d / 100) for m in (1, 2) for d in range(1, 29) for s in ("btcusd", "usdtusd", "usdusd")], "day string, symbol string, average_daily_price double")
    pairs = [PairRates("btcusd", "usdusd", "btcusd"), PairRates("btcusdt", "usdtusd", "btcusd"), PairRates("usdtusd", "usdusd", "usdtusd")]
    states = monthly.pair_states(table)
    plan = monthly.measures_of(states, rates, pairs)._jdf.queryExecution().executedPlan().toString()
    assert "start_minute" in plan and "start_second" not in plan  # all from the states
    known = table.where(~F.isnan("avg_price")).withColumn("year_month", F.date_format("start_second", "yyyy-MM"))
    want = {(r["year_month"], r["symbol"]): r for r in known.groupBy("year_month", "symbol").agg(F.avg("avg_price").alias("mean"), F.stddev_samp("avg_price").alias("dev"), F.sum("total_number_of_trades").alias("n")).collect()}
    found = {(r["year_month"], r["symbol"]): r for r in monthly.measures_of(states, rates, pairs).collect()}
    assert found and found.keys() <= want.keys()
    for key, r in found.items():
        assert (r["avg_price"], r["stddev_price"], r["total_number_of_trades"]) == (pytest.approx(want[key]["mean"]), pytest.approx(want[key]["dev"], rel=1e-9), want[key]["n"])
    stats = rows_of(monthly.statistics_of(states, monthly.daily_profit_and_volume(states, rates, pairs)))
    direct = rows_of(describe(table.where(~F.isnan("avg_price")), ["avg_price"]))
    same({k: v for k, v in stats.items() if k[1] == "avg_price"}, direct)
