import random

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import leadlag


def by_hand(rows, leader, follower, seconds):
    """The analysis on one pair as ordinary series code."""
    frame = pd.DataFrame(rows, columns=["t", "symbol", "r"])
    x = frame[frame.symbol == leader][["t", "r"]].rename(columns={"r": "x"})
    y = frame[frame.symbol == follower][["t", "r"]].rename(columns={"r": "y"})
    both = x.merge(y, on="t").sort_values("t")
    both["x"] = -both["x"]
    for c in ("x", "y"):
        both[c] = (both[c] - both[c].mean()) / both[c].std()
    both["bin"] = both.t // (seconds * 1000)
    grouped = both.groupby("bin").agg(x=("x", "sum"), y=("y", "sum"))
    full = grouped.reindex(range(grouped.index.min(), grouped.index.max() + 1))
    seen = full.x.notna()
    full = full.fillna(0.0)
    table = pd.DataFrame({f"x{k}": full.x.shift(k) for k in range(11)})
    table["y"] = full.y.shift(5)
    table = table[seen].dropna()
    out = {}
    for k in range(11):
        a, b = table[f"x{k}"].to_numpy(), table["y"].to_numpy()
        beta = a @ b / (a @ a)
        residual = b - beta * a
        t = beta / np.sqrt(residual @ residual / (len(b) - 1) / (a @ a))
        out[k] = (len(b), beta, t)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for minute in range(900):
        hour = minute // 60
        if hour in (4, 9):  # two empty hours, and minutes missing at random
            continue
        for symbol in ("ethbtc", "btcusd", "ethusd"):
            if rng.random() > 0.3:
                out.append((1_704_067_200_000 + minute * 60_000, symbol, rng.gauss(0.001, 0.01)))
    return out


@pytest.mark.parametrize("seconds", [300, 1800])
def test_against_series_code(spark, rows, seconds):
    series = spark.createDataFrame(rows, "start_ts_ob long, symbol string, logreturn double")
    fits = leadlag.with_p_value(leadlag.lead_lag(series, [seconds])).collect()
    assert len(fits) == 6 * 11
    for leader, follower in (("ethbtc", "btcusd"), ("btcusd", "ethusd")):
        want = by_hand(rows, leader, follower, seconds)
        for r in fits:
            if (r.leader, r.follower) == (leader, follower):
                n, beta, t = want[r.lag]
                assert (r.n, r.beta, r.t_statistic) == (n, pytest.approx(beta), pytest.approx(t))
                assert 0 <= r.p_value <= 1


def test_labels(spark, rows):
    assert [leadlag.lag_label(k) for k in (0, 4, 5, 6, 10)] == ["t+5", "t+1", "t", "t-1", "t-5"]
    series = spark.createDataFrame(rows, "start_ts_ob long, symbol string, logreturn double")
    table = leadlag.lead_lag_table(leadlag.lead_lag(series, [1800]), "beta")
    assert table.columns[3:] == ["t-5", "t-4", "t-3", "t-2", "t-1", "t", "t+1", "t+2", "t+3", "t+4", "t+5"]
    assert table.count() == 6


def test_no_window_over_a_pairs_history(spark, rows):
    series = spark.createDataFrame(rows, "start_ts_ob long, symbol string, logreturn double")
    assert "Window" not in leadlag.lead_lag(series, [300])._jdf.queryExecution().optimizedPlan().toString()


def test_sign_of_the_leader_is_optional(spark, rows):
    series = spark.createDataFrame(rows, "start_ts_ob long, symbol string, logreturn double")
    pick = lambda df: df.where("leader = 'ethbtc' and follower = 'btcusd' and lag = 3").first().beta
    flipped, plain = pick(leadlag.lead_lag(series, [1800])), pick(leadlag.lead_lag(series, [1800], flip_leader=False))
    assert flipped == pytest.approx(-plain)


def test_intervals_must_divide_a_day(spark, rows):
    series = spark.createDataFrame(rows, "start_ts_ob long, symbol string, logreturn double")
    with pytest.raises(ValueError):
        leadlag.lead_lag(series, [660])


def test_runs_where_workers_have_no_copy_of_the_package(tmp_path):
    """A session started elsewhere with an empty PYTHONPATH: the p-value function travels by value."""
    import os
    import subprocess
    import sys

    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\nfrom workloads.registry import QUERIES\nfrom pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "print('ROWS', QUERIES['lead_lag'](s, '/root/testdata/sf0.001').count() > 0)\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS True" in said.stdout, said.stderr[-2000:]
