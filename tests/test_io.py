import datetime as dt
import gzip
import os

import pytest
from pyspark.sql import functions as F

from tickloom import jobs
from tickloom.sources import generators, readers, schemas, writers

DAY = 1_704_067_200_000


def csv_files(path):
    return [f for f in os.listdir(path) if f.startswith("part-")]


def write_trades(root, pair, exchange, rows):
    folder = root / exchange / pair / "2024_01"
    folder.mkdir(parents=True, exist_ok=True)
    with gzip.open(folder / f"{exchange}_{pair}_trades_2024_01_01.csv.gz", "wt") as f:
        f.write("id,exchange,symbol,date,price,amount,sell\n")
        f.writelines(",".join(map(str, r)) + "\n" for r in rows)


@pytest.fixture
def provider(tmp_path):
    root = tmp_path / "trades"
    for symbol, base in (("btcusd", 100.0), ("btcusdt", 101.0), ("usdtusd", 1.0)):
        for n, exchange in enumerate(("x", "y")):
            rows = [
                (f"{exchange}{i}", exchange, symbol, DAY + i * 7_000 + n * 1000, base * (1 + ((i * 7 + n) % 11) / 1000), 1 + i % 3, str((i + n) % 2 == 0).lower())
                for i in range(600)
            ]
            write_trades(root, symbol.upper(), exchange, rows)
    return root


def test_trade_scan_by_glob(spark, provider):
    one = readers.read_trades(spark, readers.trades_glob(str(provider), "BTCUSD"))
    assert (one.count(), one.schema) == (1200, schemas.TRADES)
    both = readers.read_runs(spark, [readers.trades_glob(str(provider), p) for p in ("BTCUSD", "USDTUSD")], schemas.TRADES)
    assert both.select("symbol").distinct().count() == 2
    assert both.where("sell is null or price is null").count() == 0


def test_unreadable_files_fail_or_are_reported(spark, provider):
    bad = provider / "x" / "BTCUSD" / "2024_01" / "x_BTCUSD_trades_2024_01_02.csv.gz"
    bad.write_bytes(b"\x1f\x8b\x08\x00broken")
    glob = readers.trades_glob(str(provider), "BTCUSD")
    with pytest.raises(Exception):
        readers.read_trades(spark, glob).count()
    assert readers.read_trades(spark, glob, tolerate_corrupt=True).count() == 1200
    skipped = readers.skipped_files(spark, glob, schemas.TRADES).collect()
    assert [r.path.rpartition("/")[2] for r in skipped] == [bad.name]


def test_series_round_trip_and_global_order(spark, tmp_path):
    stamp = dt.datetime(2024, 1, 1, 0, 0, 7)
    frame = spark.range(500).select(
        (F.lit("2024-01-01T00:00:07Z").cast("timestamp") + F.make_dt_interval(secs=(F.col("id") * 37 % 500).cast("decimal(18,6)"))).alias("start_second"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.ARBITRAGE.fields[1:]],
    )
    path = str(tmp_path / "bars")
    writers.write_sorted(frame, path, "start_second")
    assert all(f.endswith(".csv.gz") for f in csv_files(path))
    back = readers.read_arbitrage(spark, path)
    assert back.select(F.min("start_second")).first()[0] is not None
    assert back.count() == 500 and back.select("start_second").distinct().count() == 500
    text = spark.read.text(path).where("value like '2024%'").orderBy("value").first().value
    assert text.startswith(stamp.strftime("%Y-%m-%dT%H:%M:%S") + "Z")


def test_report_is_one_sorted_file(spark, tmp_path):
    path = str(tmp_path / "report")
    writers.write_report(spark.range(100).select((F.col("id") * 7 % 100).alias("k")).repartition(8), path, "k")
    (name,) = csv_files(path)
    lines = open(os.path.join(path, name)).read().split()
    assert lines == ["k"] + [str(i) for i in range(100)]


def test_write_twice(spark, tmp_path):
    frame = spark.createDataFrame([("d2", 2.0), ("d1", 1.0)], "day string, v double")
    parts, report = str(tmp_path / "parts"), str(tmp_path / "report")
    writers.write_twice(frame, parts, report, "day")
    (name,) = csv_files(report)
    assert open(os.path.join(report, name)).read().split() == ["day,v", "d1,1.0", "d2,2.0"]
    assert spark.read.option("header", True).csv(parts).count() == 2


def test_month_selection_prunes_directories(spark, tmp_path):
    months = [("btcusd", 0), ("btcusd", 31), ("btcusd", 62), ("ethusd", 31)]
    rows = [(s, DAY + d * 86_400_000, 1.0) for s, d in months]
    path = str(tmp_path / "store")
    writers.write_partitioned(spark.createDataFrame(rows, "symbol string, date long, price double"), path)
    chosen = readers.select_months(spark.read.parquet(path), "btcusd", "2024-02", "2024-03")
    assert chosen.count() == 2
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan
    with pytest.raises(ValueError):
        readers.select_months(chosen, "btcusd", "2024-03", "2024-02")


def test_generated_tables(spark):
    grid = generators.time_grid(spark, "2024-01-01", "2024-01-02", 5).collect()
    assert len(grid) == 288
    assert tuple(grid[1]) == (DAY + 300_000, "2024-01-01T00:05:00Z")
    rate = [tuple(r) for r in generators.parity_rate(spark, "2024-02-28", "2024-03-02").collect()]
    assert rate == [("2024-02-28", "usdusd", 1.0), ("2024-02-29", "usdusd", 1.0), ("2024-03-01", "usdusd", 1.0)]


def test_run_name():
    now = dt.datetime(2021, 10, 10, 18, 3, 45)
    assert writers.run_name("average_daily_price", "BTCUSD", "2015-01-01", "2020-12-31", now=now) == (
        "2021-10-10__18-03-45_average_daily_price_BTCUSD_2015-01-01_2020-12-31"
    )


def test_jobs_end_to_end(spark, provider, tmp_path):
    """The whole chain from provider files to the correlation, lead-lag and monthly tables."""
    out = tmp_path / "out"

    def run(name, *args):
        folder = out / name
        jobs.main([name, "--out", str(folder), *map(str, args)], spark)
        return {f.split("_", 3)[3]: str(folder / f) for f in os.listdir(folder)}

    def rows(path):
        return spark.read.option("header", True).csv(path)

    source = str(provider / "*" / "*" / "*" / "*.gz")
    period = ["--from", "2024-01-01", "--to", "2024-01-02"]
    pairs = ["--pairs", '[["btcusd","usdusd","btcusd"],["btcusdt","usdtusd","btcusd"],["usdtusd","usdusd","usdtusd"]]']
    bars = run("trades-arbitrage", "--trades", source, *period, "--seconds", 1)
    (bars,) = bars.values()
    assert rows(bars).count() > 1000
    prices = run("daily-average-price", "--trades", source, *period)
    daily = next(p for p in prices.values() if p.endswith(".csv"))
    assert rows(daily).count() == 3
    (parity,) = run("parity-rate", *period).values()
    (grid,) = run("time-grid", *period, "--minutes", 5).values()
    assert rows(grid).count() == 288
    rates = ["--rates", daily, parity]

    measures = run("monthly-measures", "--bars", bars, *rates, *pairs)
    measure_path = next(p for n, p in measures.items() if n.startswith("arbitrage") or "measures" in n)
    assert sorted(r.symbol for r in rows(measure_path).collect()) == ["btcusd", "btcusdt", "usdtusd"]
    usd = run("monthly-measures-usd-pair", "--bars", bars, *rates)
    assert rows(next(p for n, p in usd.items() if "measures" in n)).count() == 2
    filled = run("zero-filled-stats", "--bars", bars, *period)
    volatility = next(p for n, p in filled.items() if "volatility" in n)
    assert rows(volatility).count() == 3
    tables = run("monthly-tables", "--measures", measure_path, "--volatility", volatility)
    assert rows(next(p for n, p in tables.items() if "total_volume" in n)).columns == ["symbol", "2024-01"]
    breakdown = run("intraday-breakdown", "--bars", bars, *rates, *pairs, *period)
    assert all(rows(p).count() == 72 for p in breakdown.values())
    tri = run("triangulation", "--bars", bars, "--triangle", "btcusdt", "btcusd", "usdtusd")
    tri_measures = next(p for n, p in tri.items() if n.startswith("triangulation_arbitrage"))  # beside the series
    assert rows(tri_measures).count() == 1
    assert len(run("triangle-tables", "--measures", tri_measures)) == 9 + 2
    activity = next(p for n, p in breakdown.items() if "activity" in n)
    (parity_report,) = run("parity-table", "--breakdown", activity).values()
    assert rows(parity_report).count() == 3
    (points,) = run("breakdown-points", "--breakdown", activity).values()
    assert rows(points).count() == 72 * 9
    (plot,) = run("plot-series", "--bars", bars, "--column", "total_volume", "--aggregation", "sum", "--samples", 5).values()
    assert rows(plot).count() == 3

    series = []
    for symbol, base in (("btcusd", 100.0), ("btcusdt", 101.0)):
        book = tmp_path / f"{symbol}.csv"
        with open(book, "w") as f:
            f.write("date,type,price,amount\n")
            for minute in range(70):
                for level in range(1, 6):
                    step = level * (1 + minute % 5) / 100
                    f.write(f"{DAY + minute * 60_000 + 500},b,{base - step},{level}\n")
                    f.write(f"{DAY + minute * 60_000 + 500},a,{base + step},{level}\n")
        (path,) = run("order-book-series", "--bars", bars, "--book", book, "--symbol", symbol, "--label", symbol).values() \
            if not series else [p for n, p in run("order-book-series", "--bars", bars, "--book", book, "--symbol", symbol, "--label", symbol).items() if n.endswith(f"{symbol}_1m")]
        series.append(path)
    assert rows(series[0]).count() > 60
    clean = run("clean-book-series", "--series", *series, *rates, *pairs, "--correlations")
    clean_path = next(p for n, p in clean.items() if "order_book_and_trades" in n)
    assert readers.read_book_series(spark, clean_path, clean=True).where("usd_rate = 'btcusd' and total_order_flow_usd is not null").count() > 100
    run("statistics-tables", "--statistics", next(p for n, p in clean.items() if n.startswith("statistics")))
    run("book-intraday-breakdown", "--series", *series, *period)
    (intra,) = run("intra-pair-correlation", "--series", clean_path).values()
    assert rows(intra).count() == 2 * 28
    (cross,) = run("cross-pair-correlation", "--series", clean_path).values()
    assert rows(cross).count() == 4
    both = run("correlation-tables", "--file5", cross, "--file60", cross, "--significance-threshold", 0.05)
    assert [rows(p).count() for p in both.values()] == [8, 8]
    single = run("single-pair-correlation-tables", "--file5", intra, "--file60", intra)
    assert [rows(p).count() for p in single.values()] == [12, 12]
    lead = run("lead-lag", "--series", clean_path)
    assert len(lead) == 2
