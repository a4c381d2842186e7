import random
import re

import pytest
from pyspark.sql import functions as F

from tickloom.operators import correlation as corr
from tickloom.operators import leadlag, pairing
from tickloom.session import stage

SCHEMA = "start_ts_ob long, symbol string, logreturn double, total_volume double, bid_ask_spread double"


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(8)
    rows = [(60_000 * i, f"s{k}", rng.gauss(0.01, 1), rng.random(), rng.random()) for i in range(300) for k in range(9) if rng.random() > 0.3]
    return stage(spark.createDataFrame(rows, SCHEMA), "series")


def test_pairs_meet_once(spark, series):
    rows = series.withColumnRenamed("start_ts_ob", "t").select("t", "symbol", "logreturn")
    want = None
    for blocks in (1, 2, 5, 20):
        met = pairing.paired(rows, "t", ["logreturn"], blocks=blocks)
        assert set(met.columns) == {"t", "first", "second", "x_logreturn", "y_logreturn"}
        found = sorted(map(tuple, met.select("t", "first", "second", "x_logreturn", "y_logreturn").collect()))
        want = want or found
        assert found == want and len(set(found)) == len(found)
    chosen = pairing.pair_list(spark, [("s7", "s2"), ("s2", "s7"), ("s1", "s2")])
    assert sorted(map(tuple, chosen.collect())) == [("s1", "s2"), ("s2", "s7")]
    met = pairing.paired(rows, "t", ["logreturn"], chosen)
    found = sorted(map(tuple, met.select("t", "first", "second", "x_logreturn", "y_logreturn").collect()))
    assert found == [r for r in want if r[1:3] in (("s1", "s2"), ("s2", "s7"))]
    with pytest.raises(ValueError):
        pairing.pair_list(spark, [("a", "a")])


def test_blocks_by_the_number_of_symbols(spark):
    assert pairing.symbol_blocks(spark.range(0).selectExpr("cast(id as string) as symbol")) == 1
    assert pairing.symbol_blocks(spark.range(1000).selectExpr("cast(id as string) as symbol")) == 4


def test_operators_with_blocks_and_chosen_pairs(spark, series):
    chosen = pairing.pair_list(spark, [("s3", "s0"), ("s8", "s3")])
    for make, key in ((lambda **k: corr.cross_pair(series, 300, **k), ("first", "second")), (lambda **k: leadlag.lead_lag(series, [300, 3600], **k), ("leader", "follower"))):
        every = [r.asDict() for r in make().collect()]
        split = [r.asDict() for r in make(blocks=4).collect()]
        some = [r.asDict() for r in make(pairs=chosen).collect()]
        wanted = [r for r in every if {r[key[0]], r[key[1]]} in ({"s0", "s3"}, {"s3", "s8"})]
        name = lambda r: str([r[k] for k in r if isinstance(r[k], (str, int))])
        for got, want in ((split, every), (some, wanted)):
            assert [name(r) for r in sorted(got, key=name)] == [name(r) for r in sorted(want, key=name)]
            for a, b in zip(sorted(got, key=name), sorted(want, key=name)):
                numbers = [[v for v in r.values() if isinstance(v, float)] for r in (a, b)]
                assert numbers[0] == pytest.approx(numbers[1], rel=1e-9, abs=1e-9)


def test_lead_lag_joins_symbols_once(spark, series):
    fits = leadlag.lead_lag(series, [300, 3600])
    plan = fits._jdf.queryExecution().optimizedPlan().toString()
    # the pair join is behind the staged bins; what is left joins bins to their scales
    assert len(re.findall(r"^.*Join ", plan, re.MULTILINE)) == 1 and "logreturn" not in plan
    bins = leadlag.pair_bins(series, 300)
    assert bins.where("first >= second").count() == 0


def test_a_constant_side_has_no_deviation(spark):
    rows = [(60_000 * i, s, 0.1 if s == "flat" else (i % 7) / 10, 1.0, 1.0) for i in range(400) for s in ("flat", "wave")]
    scales = leadlag.pair_scales(leadlag.pair_bins(spark.createDataFrame(rows, SCHEMA), 300)).first()
    assert (scales["first"], scales["dx"], scales["dy"] > 0) == ("flat", 0.0, True)
    fits = leadlag.lead_lag(spark.createDataFrame(rows, SCHEMA), [300]).where(F.col("leader") == "flat").collect()
    assert {r.beta for r in fits} == {None}
