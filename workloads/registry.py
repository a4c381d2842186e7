"""The registered queries: each jobs's operators over the market views, at whole-table size."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import measures as m
from tickloom.functions import timeexpr as tx
from tickloom.operators import bars as bar_ops
from tickloom.operators import book as ob
from tickloom.operators import correlation as corr
from tickloom.operators import leadlag
from tickloom.operators.cleaning import SPREAD_CAPS, DayRule, RangeRule, day_rules, outlier_filter, range_rules
from tickloom.operators.descriptive import describe
from tickloom.operators.grid import in_period
from tickloom.operators.pairing import pair_list, symbol_blocks
from tickloom.operators.rates import PairRates
from tickloom.operators.triangle import Triangle
from tickloom.plans import intraday, monthly, order_book, reports, triangulation, zero_fill
from tickloom.plans.trades import daily_average_price, trades_arbitrage
from tickloom.session import stage, staging_path
from tickloom.sources import readers, schemas, store, writers
from tickloom.sources.generators import parity_rate, time_grid
from tickloom.functions.spreads import clipped_return, price_is_known
from workloads.views import comparable, spark_view

FIRST_DAY, END_DAY = "2024-01-01", "2024-01-31"
HIST_FIRST_DAY, HIST_END_DAY = "1995-01-01", "2001-12-01"
BAR, BUCKET, DAY = 3600, 21_600, 86_400
PAIR_BAR, PAIR_BUCKET = 1800, 7200
HIST_BAR = 3600
TRIANGLE_BAR = 14_400
PAIRS = [
    PairRates("btcusd", "usdusd", "btcusd"),
    PairRates("btcusdt", "usdtusd", "btcusd"),
    PairRates("usdtusd", "usdusd", "usdtusd"),
]
SYMBOLS = [p.symbol for p in PAIRS]
CHOSEN_PAIRS = [("usdtusd", "btcusd"), ("btcusdt", "usdtusd")]
TRIANGLES = [Triangle("btcusdt", "btcusd", "usdtusd")]
DAY_RULES = [DayRule("btcusd", "2024-01-15")]
RANGE_RULES = [RangeRule("usdtusd", "avg_price", 1.001, 1.02), RangeRule("btcusdt", "avg_price", None, 105.0)]
PIVOT_MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13) if f"{y}-{m:02d}" < "2001-12"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _trades(spark, sf):
    return spark_view(spark, sf, "fx_trades")


def _bars(spark, sf, seconds=BAR):
    return stage(trades_arbitrage(_trades(spark, sf), seconds, FIRST_DAY, END_DAY), "bars")


def _hist_bars(spark, sf, seconds=HIST_BAR):
    return stage(trades_arbitrage(spark_view(spark, sf, "fx_trades_hist"), seconds), "hist-bars")


def _rates(spark, trades, first_day, end_day):
    daily = daily_average_price(trades).select("day", "symbol", "average_daily_price")
    return daily.where(F.col("symbol").isin("btcusd", "usdtusd")).unionByName(
        parity_rate(spark, first_day, end_day)
    )


def _hist_rates(spark, sf):
    return _rates(spark, spark_view(spark, sf, "fx_trades_hist"), HIST_FIRST_DAY, HIST_END_DAY)


def _recent_rates(spark, sf):
    return _rates(spark, _trades(spark, sf), FIRST_DAY, END_DAY)


# trades -----------------------------------------------------------------------------------------


@query
def daily_average_price_hist(spark, sf):
    return comparable(daily_average_price(spark_view(spark, sf, "fx_trades_hist")))


@query
def exchange_bars(spark, sf):
    bars = bar_ops.exchange_bars(_trades(spark, sf), BAR)
    return comparable(bars.withColumnRenamed("start_ms", "start"))


@query
def trades_arbitrage_bars(spark, sf):
    return comparable(trades_arbitrage(_trades(spark, sf), BAR, FIRST_DAY, END_DAY))


@query
def trades_arbitrage_hist(spark, sf):
    return comparable(trades_arbitrage(spark_view(spark, sf, "fx_trades_hist"), DAY))


@query
def trades_arbitrage_ignore_nan(spark, sf):
    bars = trades_arbitrage(_trades(spark, sf), BAR, FIRST_DAY, END_DAY, nan_policy="ignore")
    return comparable(bars.select("start_second", "symbol", "max_price_trades_bid", "arbitrage_spread"))


@query
def open_close_range_return(spark, sf):
    bars = bar_ops.open_close_bars(_trades(spark, sf), BUCKET)
    return comparable(bars.withColumnRenamed("start_ms", "start"))


# time -------------------------------------------------------------------------------------------


@query
def time_functions(spark, sf):
    ms = F.col("date")
    second = F.floor(ms / 1000)
    stamp = F.timestamp_millis(ms)
    return comparable(
        _trades(spark, sf).select(
            "id",
            tx.bucket_iso(ms, 5).alias("bucket_iso_5"),
            tx.bucket_ms(ms, 660).alias("bucket_ms_660"),
            tx.bucket_s(second, 180).alias("bucket_s_180"),
            tx.bucket_s_to_ms(second, 900).alias("bucket_s_to_ms_900"),
            tx.minute_of_day_s(second, 5).alias("minute_of_day_5"),
            tx.minute_of_day_ms(ms, 60).alias("minute_of_day_60"),
            tx.iso_instant(ms).alias("instant"),
            tx.day_of_ms(ms).alias("day"),
            tx.day_of_s(second).alias("day_s"),
            tx.day_of_ts(stamp).alias("day_ts"),
            tx.minute_iso(second).alias("minute"),
            tx.minute_start_s(second).alias("minute_epoch"),
            tx.month_of_ms(ms).alias("month"),
            tx.month_of_s(second).alias("month_s"),
            tx.month_of_ts(stamp).alias("month_ts"),
            tx.month_of_day(tx.day_of_ms(ms)).alias("month_day"),
            tx.provider_time_to_ms(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'0000'")).alias("provider_ms"),
        )
    )


@query
def time_grid_coverage(spark, sf):
    """The one-hour grid with the number of trades in each interval."""
    counts = _trades(spark, sf).groupBy(tx.bucket_ms(F.col("date"), 3600).alias("start")).agg(
        F.count("*").alias("number_of_trades")
    )
    return comparable(time_grid(spark, FIRST_DAY, END_DAY, 60).join(counts, "start", "left"))


@query
def parity_rate_coverage(spark, sf):
    """The parity rate of every day with the number of trades of that day."""
    counts = spark_view(spark, sf, "fx_trades_hist").groupBy(tx.day_of_ms(F.col("date")).alias("day")).agg(
        F.count("*").alias("number_of_trades")
    )
    return comparable(parity_rate(spark, HIST_FIRST_DAY, HIST_END_DAY).join(counts, "day", "left"))


# cleaning and statistics ------------------------------------------------------------------------


@query
def descriptive_statistics(spark, sf):
    bars = trades_arbitrage(_trades(spark, sf), BAR, FIRST_DAY, END_DAY).where(price_is_known())
    return comparable(describe(bars, ["avg_price", "total_volume", "arbitrage_spread"]))


@query
def outlier_filter_bars(spark, sf):
    bars = _bars(spark, sf).where(price_is_known())
    bucket = tx.bucket_s_to_ms(F.unix_seconds("start_second"), DAY)
    kept = outlier_filter(bars.withColumn("start_ts", bucket), ["symbol", "start_ts"], "avg_price", 1.5, bounded=True)
    return comparable(kept.select("start_ts", "start_second", "symbol", "avg_price"))


@query
def anomaly_rules(spark, sf):
    bars = trades_arbitrage(_trades(spark, sf), BAR, FIRST_DAY, END_DAY)
    kept = bars.where(
        price_is_known() & day_rules(DAY_RULES) & range_rules(RANGE_RULES) & day_rules() & clipped_return("arbitrage_spread")
    )
    return comparable(kept.select("start_second", "symbol", "avg_price", "arbitrage_spread"))


@query
def clip_outliers(spark, sf):
    bars = _bars(spark, sf).where(price_is_known()).withColumn("avg_price_parity", F.col("avg_price") - 1.0)
    clipped = reports.clipped_parity(bars, ["usdtusd"])
    return comparable(clipped.select("start_second", "symbol", "avg_price_parity"))


# monthly ----------------------------------------------------------------------------------------


@query
def monthly_volatility(spark, sf):
    bars = trades_arbitrage(spark_view(spark, sf, "fx_trades_hist"), HIST_BAR)
    return comparable(monthly.monthly_volatility(monthly.minute_returns(bars, day_rules(), seconds=DAY)))


@query
def monthly_measures(spark, sf):
    return comparable(monthly.monthly_measures(_hist_bars(spark, sf), _hist_rates(spark, sf), PAIRS, DAY))


@query
def monthly_measures_usd_pair(spark, sf):
    return comparable(monthly.monthly_measures_usd_pair(_hist_bars(spark, sf), _hist_rates(spark, sf), DAY))


@query
def monthly_statistics(spark, sf):
    return comparable(monthly.monthly_statistics(_hist_bars(spark, sf), _hist_rates(spark, sf), PAIRS, DAY))


@query
def monthly_statistics_usd_pair(spark, sf):
    return comparable(monthly.monthly_statistics_usd_pair(_hist_bars(spark, sf), _hist_rates(spark, sf), DAY))


def _hist_volatility(spark, sf, bars):
    series = stage(zero_fill.return_series(bars, DAY), "series")
    return zero_fill.sparse_monthly_volatility(series, HIST_FIRST_DAY, HIST_END_DAY, DAY)


@query
def combined_monthly(spark, sf):
    bars = _hist_bars(spark, sf)
    measures = monthly.monthly_measures(bars, _hist_rates(spark, sf), PAIRS, DAY)
    combined = monthly.combine_monthly(measures, _hist_volatility(spark, sf, bars))
    return comparable(
        combined.select(
            "year_month", "symbol", "avg_price", "arbitrage_profit_in_usd", "monthly_volatility_logreturns",
            "annualized_monthly_volatility_logreturns",
        )
    )


@query
def monthly_pivot(spark, sf):
    measures = monthly.monthly_measures(_hist_bars(spark, sf), _hist_rates(spark, sf), PAIRS, DAY)
    column = "total_volume_in_usd"
    table = reports.monthly_pivot(measures, column, PIVOT_MONTHS, reports.SINGLE_PAIR_TABLES[column])
    return comparable(table.select("symbol", *[F.col(f"`{c}`").alias(f"m_{c[:4]}_{c[5:]}") for c in PIVOT_MONTHS]))


@query
def arbitrage_summary(spark, sf):
    measures = monthly.monthly_measures(_hist_bars(spark, sf), _hist_rates(spark, sf), PAIRS, DAY)
    return comparable(reports.arbitrage_summary(measures))


# zero filling -----------------------------------------------------------------------------------


def _series(spark, sf):
    return stage(zero_fill.return_series(_bars(spark, sf), BUCKET), "series")


def _filled(spark, sf):
    series = _series(spark, sf)
    return series, zero_fill.zero_filled_series(series, FIRST_DAY, END_DAY, BUCKET)


@query
def zero_filled_series(spark, sf):
    return comparable(_filled(spark, sf)[1])


@query
def zero_filled_statistics(spark, sf):
    return comparable(zero_fill.sparse_statistics(_series(spark, sf), FIRST_DAY, END_DAY, BUCKET))


@query
def realized_volatility_daily(spark, sf):
    return comparable(zero_fill.daily_volatility(_filled(spark, sf)[1]))


@query
def realized_volatility_monthly(spark, sf):
    return comparable(_hist_volatility(spark, sf, _hist_bars(spark, sf)))


# intraday ---------------------------------------------------------------------------------------


def _bins(spark, sf):
    bars = trades_arbitrage(_trades(spark, sf), PAIR_BAR, FIRST_DAY, END_DAY)
    return intraday.filled_bins(bars, _recent_rates(spark, sf), PAIRS, FIRST_DAY, END_DAY, BAR)


@query
def intraday_breakdown(spark, sf):
    return comparable(intraday.intraday_breakdown(_bins(spark, sf), BUCKET))


@query
def intraday_variance_breakdown(spark, sf):
    return comparable(intraday.intraday_variance(_bins(spark, sf), BUCKET))


@query
def parity_table(spark, sf):
    return comparable(reports.parity_table(intraday.intraday_breakdown(_bins(spark, sf), BUCKET)))


@query
def breakdown_points(spark, sf):
    breakdown = intraday.intraday_breakdown(_bins(spark, sf), BUCKET)
    return comparable(reports.breakdown_points(breakdown, ["total_volume_in_usd", "avg_price_parity"]))


@query
def daily_plot_series(spark, sf):
    bars = _bars(spark, sf)
    return comparable(reports.plot_series(bars, "total_volume", "sum", 7))


@query
def sampled_plot_series(spark, sf):
    bars = _bars(spark, sf)
    return comparable(reports.plot_series(bars, "total_volume", None, 100))


# order book -------------------------------------------------------------------------------------


def _book(spark, sf):
    return spark_view(spark, sf, "fx_book")


@query
def order_book_top(spark, sf):
    times = stage(ob.snapshot_times(_book(spark, sf), BUCKET), "times")
    return comparable(ob.top_of_book(ob.snapshot_levels(_book(spark, sf), times)))


@query
def execution_price(spark, sf):
    """Cost of trading 1, 3 and 40 times a size that differs between snapshots, the last beyond most books."""
    times = stage(ob.snapshot_times(_book(spark, sf), BUCKET), "times")
    levels = ob.banded_levels(ob.snapshot_levels(_book(spark, sf), times))
    size = F.pmod(F.floor(F.col("start_ts") / (BUCKET * 1000)), F.lit(7)) * 10.0 + 0.25
    sizes = times.select("symbol", "start_ts", size.alias("size"))
    multipliers = [1.0, 3.0, 40.0]
    prices = ob.execution_prices(levels, sizes, multipliers)
    rows = [
        F.struct(F.lit(k).alias("multiplier"), F.col(f"execution_price_{k:g}").alias("execution_price"))
        for k in multipliers
    ]
    return comparable(prices.select("symbol", "start_ts", "bid", F.inline(F.array(*rows))))


@query
def liquidity_imbalance(spark, sf):
    series = order_book.order_book_series(_book(spark, sf), _bars(spark, sf), BUCKET)
    return comparable(
        series.select(
            "start_ts_ob", "symbol", "bid_ask_spread", "midpoint_ob", "avg_trade_size", "liquidity_imbalance_1avg",
            "liquidity_imbalance_2avg", "liquidity_imbalance_3avg",
        )
    )


def _pair_series(spark, sf):
    book = spark_view(spark, sf, "fx_book_pairs")
    return order_book.order_book_series(book, _bars(spark, sf, PAIR_BAR), PAIR_BUCKET)


@query
def order_book_series(spark, sf):
    return comparable(_pair_series(spark, sf))


def _clean_series(spark, sf):
    series = stage(_pair_series(spark, sf), "book-series")
    return order_book.clean_book_series(series, _recent_rates(spark, sf), PAIRS, DAY)


@query
def book_clean_series(spark, sf):
    return comparable(_clean_series(spark, sf))


@query
def book_statistics(spark, sf):
    return comparable(order_book.clean_book_statistics(_clean_series(spark, sf)))


@query
def book_intraday_breakdown(spark, sf):
    series = stage(_pair_series(spark, sf), "book-series")
    return comparable(
        order_book.book_intraday_breakdown(series, FIRST_DAY, END_DAY, PAIR_BUCKET, BUCKET)
    )


@query
def statistics_report(spark, sf):
    clean = stage(_clean_series(spark, sf), "clean")
    statistics = order_book.clean_book_statistics(clean).unionByName(describe(clean, ["total_number_of_trades"]))
    return comparable(reports.statistics_report(statistics.unionByName(statistics)))


# correlation and lead-lag -----------------------------------------------------------------------


@query
def intra_pair_correlation(spark, sf):
    clean = _clean_series(spark, sf)
    return comparable(corr.with_significance(corr.intra_pair(clean, BUCKET)), t_statistic=5)


@query
def cross_pair_correlation(spark, sf):
    clean = stage(_clean_series(spark, sf), "clean")
    return comparable(corr.with_significance(corr.cross_pair(clean, BUCKET, blocks=symbol_blocks(clean))), t_statistic=5)


@query
def measure_matrix(spark, sf):
    return comparable(corr.measure_matrix(_clean_series(spark, sf)))


@query
def lead_lag(spark, sf):
    clean = stage(_clean_series(spark, sf), "clean")
    return comparable(leadlag.with_p_value(leadlag.lead_lag(clean, [BUCKET, 43_200], blocks=symbol_blocks(clean))), t_statistic=5)


@query
def lead_lag_chosen_pairs(spark, sf):
    """Leads and lags of the chosen pairs alone, in both directions."""
    clean = stage(_clean_series(spark, sf), "clean")
    chosen = pair_list(spark, CHOSEN_PAIRS)
    return comparable(leadlag.with_p_value(leadlag.lead_lag(clean, [BUCKET], flip_leader=False, pairs=chosen)), t_statistic=5)


@query
def cross_pair_chosen_pairs(spark, sf):
    clean = stage(_clean_series(spark, sf), "clean")
    chosen = pair_list(spark, CHOSEN_PAIRS)
    return comparable(corr.with_significance(corr.cross_pair(clean, BUCKET, pairs=chosen)), t_statistic=5)


@query
def lead_lag_table(spark, sf):
    clean = stage(_clean_series(spark, sf), "clean")
    table = leadlag.lead_lag_table(leadlag.lead_lag(clean, [BUCKET]), "beta")
    labels = {leadlag.lag_label(k): f"t_{'minus' if k > 5 else 'plus'}_{abs(5 - k)}" for k in leadlag.LAGS}
    return comparable(
        table.select("leader", "follower", "interval", *[F.col(f"`{a}`").alias(b) for a, b in labels.items()])
    )


@query
def correlation_matrix(spark, sf):
    clean = stage(_clean_series(spark, sf), "clean")
    fast = stage(corr.with_significance(corr.cross_pair(clean, BUCKET)), "fast")
    slow = corr.with_significance(corr.cross_pair(clean, DAY))
    return comparable(reports.correlation_matrix(fast, slow, sorted(SYMBOLS), ["measure"], 0.02, 0.5))


@query
def single_pair_matrix(spark, sf):
    clean = stage(_clean_series(spark, sf), "clean")
    fast = corr.with_significance(corr.intra_pair(clean, BUCKET))
    slow = stage(corr.with_significance(corr.intra_pair(clean, DAY)), "slow")
    shown = sorted(set(corr.INTRA_MEASURES) - set(reports.OMITTED_MEASURES))
    matrix = reports.correlation_matrix(slow, fast, shown, ["symbol"], None, 0.1)
    return comparable(reports.matrix_table(matrix, ["symbol"], shown))


# triangulation ----------------------------------------------------------------------------------


@query
def triangulation_bars(spark, sf):
    bars = trades_arbitrage(_trades(spark, sf), TRIANGLE_BAR, FIRST_DAY, END_DAY)
    return comparable(triangulation.triangulation(bars, TRIANGLES))


def _triangle_monthly(spark, sf):
    bars = trades_arbitrage(spark_view(spark, sf, "fx_trades_hist"), HIST_BAR)
    series = stage(triangulation.triangulation(bars, TRIANGLES), "triangles")
    return triangulation.triangulation_monthly(series, DAY)


@query
def triangulation_monthly(spark, sf):
    return comparable(_triangle_monthly(spark, sf))


@query
def triangle_summary(spark, sf):
    measures = stage(_triangle_monthly(spark, sf), "triangle-monthly")
    sides = [
        reports.arbitrage_summary(measures, side).withColumn("side", F.lit(side)) for side in ("sell", "buy")
    ]
    return comparable(sides[0].unionByName(sides[1]))


# files and stores -------------------------------------------------------------------------------


@query
def trades_files(spark, sf):
    """All trades after a way through sorted gzip CSV parts."""
    path = staging_path(spark, "trades-csv")
    writers.write_sorted(_trades(spark, sf).select(*schemas.TRADES.names), path, "date", "id")
    return comparable(readers.read_trades(spark, path))


@query
def arbitrage_files(spark, sf):
    """The bars after a way through gzip parts, and through the single-file copy made of these."""
    path = staging_path(spark, "bars")
    writers.write_twice(_bars(spark, sf), f"{path}.csv.gz", f"{path}.csv", "start_second", "symbol")
    copies = [readers.read_arbitrage(spark, f"{path}.{end}").withColumn("copy", F.lit(end)) for end in ("csv.gz", "csv")]
    return comparable(copies[0].unionByName(copies[1]))


@query
def book_series_files(spark, sf):
    path = staging_path(spark, "series")
    writers.write_parts(_pair_series(spark, sf), path, gzip=True)
    return comparable(readers.read_book_series(spark, path))


@query
def time_grid_files(spark, sf):
    """As ``time_grid_coverage``, with the grid read from its files."""
    path = staging_path(spark, "grid")
    writers.write_parts(time_grid(spark, FIRST_DAY, END_DAY, 60), path, gzip=True)
    counts = _trades(spark, sf).groupBy(tx.bucket_ms(F.col("date"), 3600).alias("start")).agg(
        F.count("*").alias("number_of_trades")
    )
    return comparable(readers.read_time_grid(spark, path).join(counts, "start", "left"))


@query
def rates_by_name(spark, sf):
    """Daily prices and parity rates, files with different headers, as one table."""
    paths = [staging_path(spark, name) for name in ("daily", "parity")]
    writers.write_parts(daily_average_price(spark_view(spark, sf, "fx_trades_hist")), paths[0])
    writers.write_parts(parity_rate(spark, HIST_FIRST_DAY, HIST_END_DAY), paths[1], gzip=True)
    return comparable(readers.read_rates(spark, paths))


@query
def combined_runs(spark, sf):
    """Daily prices of two overlapping runs: the later one covers the years from 1998 and lacks a column."""
    daily = daily_average_price(spark_view(spark, sf, "fx_trades_hist"))
    folder = staging_path(spark, "runs")
    late = daily.where("day >= '1998'").withColumn("average_daily_price", F.col("average_daily_price") * 2).drop("total_amount")
    for frame, year in ((daily, 2020), (late, 2021)):
        stamp = datetime(year, 5, 6, 7, 8, 9, tzinfo=timezone.utc)
        writers.write_parts(frame, f"{folder}/{writers.run_name('average_daily_price', 'all', now=stamp)}")
    runs = readers.read_stamped(spark, [f"{folder}/*_average_daily_price_*"], schemas.DAILY_PRICE, ["day", "symbol"])
    return comparable(readers.newest(runs, ["day", "symbol"]))


@query
def file_accounts(spark, sf):
    """Rows of all files of the trades, by what was read of each, and how many broke off."""
    path = staging_path(spark, "accounts")
    writers.write_parts(_trades(spark, sf).select(*schemas.TRADES.names), path, gzip=True)
    account = readers.file_account(spark, path)
    return comparable(account.groupBy().agg(F.sum("rows").alias("number_of_trades"), F.count_if(~F.col("complete")).alias("incomplete_files")))


SELECTIONS = [store.Selection("btcusd", "1996-01", "1996-06"), store.Selection("usdtusd", "2000-10")]


@query
def store_selection(spark, sf):
    """Daily prices from a store of all trades, of one symbol over six months and another from a month on."""
    path = staging_path(spark, "store")
    store.write(spark_view(spark, sf, "fx_trades_hist"), path, "trades")
    return comparable(daily_average_price(store.read(spark, path, "trades", SELECTIONS)))


@query
def book_store(spark, sf):
    """The top of a book that is read from its store."""
    path = staging_path(spark, "store")
    store.write(_book(spark, sf), path, "book")
    book = store.read(spark, path, "book", [store.Selection("btcusd", "2024-01", "2024-12")])
    times = stage(ob.snapshot_times(book, BUCKET), "times")
    return comparable(ob.top_of_book(ob.snapshot_levels(book, times)))


@query
def spread_caps(spark, sf):
    """Tops of books whose spread lies below the cap of their symbol."""
    book = spark_view(spark, sf, "fx_book_capped")
    times = stage(ob.snapshot_times(book, BUCKET), "times")
    return comparable(ob.top_of_book(ob.snapshot_levels(book, times)).where(range_rules(SPREAD_CAPS)))


@query
def period_by_arguments(spark, sf):
    """Trades per day between an instant and a day as jobs take them."""
    first, end = tx.instant_arg_to_ms("2024-01-05T06:30:00.250+02:00"), tx.day_arg_to_ms("2024-01-20")
    counts = in_period(_trades(spark, sf), "date", first, end).groupBy(tx.day_of_ms(F.col("date")).alias("day"), "symbol").agg(F.count("*").alias("number_of_trades"))
    return comparable(counts.withColumn("end_day", F.lit(tx.ms_to_day_arg(end))))


# measures that no job above uses ----------------------------------------------------------------


@query
def constant_columns(spark, sf):
    """Columns that are constant within their group; the query fails if one is not."""
    trades = _trades(spark, sf)
    bars = trades.withColumn("day", tx.day_of_ms(F.col("date"))).groupBy("id").agg(
        m.constant_of(F.col("symbol"), "symbol").alias("symbol"), m.constant_of(F.col("day"), "day").alias("day")
    )
    return comparable(bars.groupBy("symbol", "day").agg(F.count("*").alias("number_of_trades")))
