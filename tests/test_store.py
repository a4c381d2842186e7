import gzip
import os

import pytest
from pyspark.sql import functions as F

from tests.test_io import DAY, provider, write_trades  # noqa: F401
from tickloom import jobs
from tickloom.sources import readers, schemas, store, writers

TRADE = "id string, exchange string, symbol string, date long, price double, amount double, sell boolean"


def trades(spark, rows):
    return spark.createDataFrame([(f"t{i}", "x", s, t, p, 1.0, False) for i, (s, t, p) in enumerate(rows)], TRADE)


def test_a_store_is_sorted_and_pruned(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(s, DAY + (i * 7919 % 5000) * 3_600_000, float(i)) for i in range(2000) for s in ("btcusd", "ethusd")]
    rows += [(None, DAY, 1.0), ("btcusd", None, 2.0)]
    store.write(trades(spark, rows), path, "trades")
    assert sorted(os.listdir(path))[-1].startswith("symbol=") and store.read(spark, path, "trades").schema == schemas.TRADES
    assert store.read(spark, path, "trades").count() == len(rows)
    part = store.read(spark, path, "trades", [store.Selection("btcusd", "2024-02", "2024-03"), store.Selection("ethusd", "2024-07")])
    want = [r for r in rows if r[1] is not None and ((r[0] == "btcusd" and 31 <= (r[1] - DAY) // 86_400_000 < 91) or (r[0] == "ethusd" and r[1] >= DAY + 182 * 86_400_000))]
    assert part.count() == len(want)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    folder = os.path.join(path, "symbol=btcusd", "year_month=2024-02")
    for file in (f for f in os.listdir(folder) if f.endswith(".parquet")):
        times = [r.date for r in spark.read.parquet(os.path.join(folder, file)).collect()]
        assert times == sorted(times)
    with pytest.raises(ValueError):
        store.read(spark, path, "trades", [store.Selection("btcusd", "2024-03", "2024-02")])


def test_writing_again_replaces_only_the_months_it_holds(spark, tmp_path):
    path = str(tmp_path / "store")
    month = 31 * 86_400_000
    store.write(trades(spark, [("a", DAY, 1.0), ("a", DAY + month, 2.0), ("b", DAY, 3.0)]), path, "trades")
    store.write(trades(spark, [("a", DAY + 5, 9.0)]), path, "trades")
    assert sorted((r.symbol, r.price) for r in store.read(spark, path, "trades").collect()) == [("a", 2.0), ("a", 9.0), ("b", 3.0)]


def run(spark, out, name, *args):
    jobs.main([name, "--out", str(out / name), *map(str, args)], spark)
    return {f.split("_", 3)[3]: str(out / name / f) for f in os.listdir(out / name)} if (out / name).exists() else {}


def test_jobs_read_a_store_by_symbol_and_month(spark, provider, tmp_path):  # noqa: F811
    source, where = str(provider / "*" / "*" / "*" / "*.gz"), tmp_path / "trades-store"
    run(spark, tmp_path, "store", "--kind", "trades", "--input", source, "--store", where)
    period = ["--from", "2024-01-01", "--to", "2024-01-02"]
    rows = lambda p: spark.read.option("header", True).csv(p)
    found = run(spark, tmp_path, "daily-average-price", "--trades", where, *period, "--format", "store", "--select", "btcusd", "usdtusd", "--months-range", "2024-01", "2024-01")
    assert sorted(r.symbol for r in rows(next(p for p in found.values() if p.endswith(".csv"))).collect()) == ["btcusd", "usdtusd"]
    whole = run(spark, tmp_path / "all", "daily-average-price", "--trades", source, *period)
    both = [rows(next(p for p in f.values() if p.endswith(".csv"))).where("symbol = 'btcusd'").first() for f in (found, whole)]
    assert [r.number_of_trades for r in both] == ["1200"] * 2 and float(both[0].average_daily_price) == pytest.approx(float(both[1].average_daily_price))
    with pytest.raises(ValueError):
        run(spark, tmp_path, "daily-average-price", "--trades", source, *period, "--select", "btcusd")


def test_a_file_that_breaks_off_is_accounted_for(spark, provider, tmp_path):  # noqa: F811
    folder = provider / "x" / "BTCUSD" / "2024_01"
    rows = "".join(f"z{i},x,btcusd,{DAY + i},{100 + i % 7}.25,{i % 13},true\n" for i in range(40_000))
    packed = gzip.compress(("id,exchange,symbol,date,price,amount,sell\n" + rows).encode())
    cut = folder / "x_BTCUSD_trades_2024_01_02.csv.gz"
    cut.write_bytes(packed[: len(packed) // 2])
    (folder / "x_BTCUSD_trades_2024_01_03.csv.gz").write_bytes(gzip.compress(b"id,exchange,symbol,date,price,amount,sell\r\na,x,btcusd,1,2.0,3.0,true\r\nb,x,btcusd,2,2.0,3.0,true"))
    (folder / "x_BTCUSD_trades_2024_01_04.csv.gz").write_bytes(b"\x1f\x8b\x08\x00broken")
    glob = readers.trades_glob(str(provider), "BTCUSD")
    found = {r.path.rpartition("/")[2]: r for r in readers.file_account(spark, glob).collect()}
    taken = readers.read_trades(spark, glob, tolerate_corrupt=True)
    per_file = {r.f.rpartition("/")[2]: r["count"] for r in taken.groupBy(F.col("_metadata.file_path").alias("f")).count().collect()}
    assert [f for f, r in sorted(found.items()) if not r.complete] == [cut.name, "x_BTCUSD_trades_2024_01_04.csv.gz"]
    broken = found[cut.name]
    assert 0 < broken.rows < 40_000 and 0 < broken.bytes_read < len(rows) and abs(per_file[cut.name] - broken.rows) <= 1
    assert {f: r.rows for f, r in found.items() if r.complete} == {f: n for f, n in per_file.items() if f != cut.name}
    period = ["--from", "2024-01-01", "--to", "2024-01-05"]
    made = run(spark, tmp_path, "daily-average-price", "--trades", glob, *period, "--tolerate-corrupt")
    listed = spark.read.option("header", True).csv(next(p for n, p in made.items() if n.startswith("incomplete_files"))).collect()
    assert [(r.path.rpartition("/")[2], int(r.rows)) for r in listed] == [(cut.name, broken.rows), ("x_BTCUSD_trades_2024_01_04.csv.gz", 0)]
    with pytest.raises(Exception):
        run(spark, tmp_path / "strict", "daily-average-price", "--trades", glob, *period)


def test_plain_files_are_accounted_for(spark, tmp_path):
    (tmp_path / "a.csv").write_text("day,symbol\nd1,s\n\nd2,é")
    (tmp_path / "b.csv").write_text("")
    found = {r.path.rpartition("/")[2]: (r.rows, r.complete) for r in readers.file_account(spark, str(tmp_path)).collect()}
    assert found == {"a.csv": (2, True)}  # Spark lists no file of no length


def test_columns_are_bound_by_name(spark, tmp_path):
    for name, text in {
        "daily.csv": "day,symbol,number_of_trades,total_amount,average_daily_price\n2024-01-01T00:00:00.000Z,btcusd,5,7.5,100.5\n",
        "parity.csv": '"average_daily_price","day","symbol"\n1.0,2024-01-01,usdusd\n',
        "more.csv": "symbol,unknown,average_daily_price,day\nethusd,x,3.5,2024-01-02\nethusd,,,2024-01-03\n",
        "empty.csv": "",
    }.items():
        (tmp_path / name).write_text(text)
    rates = readers.read_rates(spark, str(tmp_path))
    assert rates.schema == schemas.PARITY_RATE
    want = [("2024-01-01", "btcusd", 100.5), ("2024-01-01", "usdusd", 1.0), ("2024-01-02", "ethusd", 3.5), ("2024-01-03", "ethusd", None)]
    assert sorted(map(tuple, rates.collect())) == want
    many = readers.read_named(spark, str(tmp_path), schemas.DAILY_PRICE, ["day", "symbol"])
    assert sorted((r.symbol, r.total_amount) for r in many.collect() if r.total_amount) == [("btcusd", 7.5)]
    scans = rates._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    assert scans == 3  # one for each header
    (tmp_path / "wrong.csv").write_text("day,pair,price\n2024-01-01,btcusd,1\n")
    with pytest.raises(ValueError, match="symbol"):
        readers.read_rates(spark, str(tmp_path))
    with pytest.raises(ValueError):
        readers.read_rates(spark, str(tmp_path / "empty.csv"))


def monthly(spark, path, rows, columns):
    frame = spark.createDataFrame(rows, f"year_month string, symbol string, {columns}")
    writers.write_parts(frame, path)


def test_the_newest_of_overlapping_runs_wins(spark, tmp_path):
    runs = tmp_path / "runs"
    old, new = (str(runs / f"{stamp}_monthly_arbitrage_measures_all") for stamp in ("2021-01-01__00-00-00", "2021-02-01__12-00-00"))
    monthly(spark, old, [("2020-01", "a", 1.0, 5), ("2020-02", "a", 2.0, 6), ("2020-01", "b", 3.0, 7)], "avg_price double, total_number_of_trades long")
    monthly(spark, new, [("2020-02", "a", 20.0), ("2020-03", "a", None), ("2020-03", "a", 30.0)], "avg_price double")
    table = readers.read_stamped(spark, [str(runs / "*")], schemas.MONTHLY_MEASURES, ["year_month", "symbol"])
    assert table.columns == [*schemas.MONTHLY_MEASURES.names, "run"] and table.count() == 6
    found = {(r.year_month, r.symbol): (r.avg_price, r.total_number_of_trades, r.run) for r in readers.newest(table, ["year_month", "symbol"]).collect()}
    first, last = "2021-01-01__00-00-00", "2021-02-01__12-00-00"
    assert found == {("2020-01", "a"): (1.0, 5, first), ("2020-01", "b"): (3.0, 7, first), ("2020-02", "a"): (20.0, None, last), ("2020-03", "a"): (30.0, None, last)}
    rows = lambda p: spark.read.option("header", True).csv(p)
    (one,) = run(spark, tmp_path, "combine-runs", "--table", "monthly-measures", "--runs", runs / "*").values()
    assert rows(one).count() == 4 and len([f for f in os.listdir(one) if f.startswith("part-")]) == 1
    (parts,) = run(spark, tmp_path / "parts", "combine-runs", "--table", "monthly-measures", "--runs", runs / "*", "--all-runs", "--parts").values()
    assert rows(parts).count() == 6 and all(f.endswith(".csv.gz") for f in os.listdir(parts) if f.startswith("part-"))


def test_pair_choice_of_the_jobs(spark, tmp_path):
    names = schemas.CLEAN_SERIES.names
    values = {"start_ts_ob": lambda i, s: DAY + i * 60_000, "symbol": lambda i, s: s, "logreturn": lambda i, s: ((i * 37 + len(s)) % 17 - 8) / 100, "total_volume": lambda i, s: float(i % 9), "bid_ask_spread": lambda i, s: float((i + len(s)) % 5)}
    rows = [tuple(values.get(n, lambda i, s: None)(i, s) for n in names) for i in range(900) for s in ("a", "bb", "ccc")]
    path = str(tmp_path / "clean")
    writers.write_parts(spark.createDataFrame(rows, schemas.CLEAN_SERIES), path)
    count = lambda *args: [spark.read.option("header", True).csv(p).count() for p in run(spark, tmp_path / str(len(os.listdir(tmp_path))), *args).values()]
    assert count("cross-pair-correlation", "--series", path) == [12]
    assert count("cross-pair-correlation", "--series", path, "--pairs-list", '[["ccc","a"]]') == [4]
    assert count("lead-lag", "--series", path, "--symbols", "a", "bb") == [4, 4]
    with pytest.raises(ValueError):
        count("lead-lag", "--series", path, "--symbols", "a", "--pairs-list", "[]")
