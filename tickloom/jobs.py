"""Command line: ``python -m tickloom.jobs <job> --help`` (or through spark-submit).

Each job reads tables, runs one plan for every symbol they hold, and writes its results under
``--out``. Tables are CSV directories with a header, or Parquet with ``--format parquet``.
"""

from __future__ import annotations

import argparse
import json
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import correlation, leadlag, pairing
from tickloom.operators.rates import PairRates, check_pairs
from tickloom.operators.triangle import Triangle
from tickloom.plans import intraday, monthly, order_book, reports, trades, triangulation, zero_fill
from tickloom.session import build_session, stage, staging_run
from tickloom.sources import generators, readers, schemas, store, writers

JOBS = {}


def job(name: str, *arguments: tuple):
    def register(fn):
        JOBS[name] = (fn, arguments)
        return fn

    return register


def arg(*names: str, **options) -> tuple:
    return names, options


BARS = arg("--bars", required=True, nargs="+", help="arbitrage series")
RATES = arg("--rates", required=True, nargs="+", help="daily prices, including parity rates")
PAIRS = arg(
    "--pairs", required=True, help='JSON list of [symbol, quote rate, base rate], e.g. [["btcusdt","usdtusd","btcusd"]]'
)
PERIOD = (arg("--from", dest="first", required=True, metavar="DAY"), arg("--to", dest="last", required=True, metavar="DAY"))
TRADES = arg("--trades", required=True, nargs="+", help="trade files or globs")
SERIES = arg("--series", required=True, nargs="+", help="order-book series")
MINUTES = arg("--minutes", type=int, default=5)
PAIR_CHOICE = (
    arg("--pairs-list", help='JSON list of pairs of symbols, e.g. [["ethbtc","btcusd"]]; by default all pairs'),
    arg("--symbols", nargs="+", help="take all pairs of these symbols alone"),
)


class Context:
    def __init__(self, spark: SparkSession, args: argparse.Namespace, name: str):
        self.spark, self.args, self.name = spark, args, name
        if args.format != "store" and (args.select or args.months_range):
            raise ValueError("--select and --months-range need --format store")

    def table(self, paths: list[str], schema) -> DataFrame:
        """The files behind ``paths``, or the selected part of a store."""
        if self.args.format != "store":
            return readers.read_table(self.spark, paths, schema, self.args.format)
        (kind,) = [name for name, k in store.KINDS.items() if k.schema == schema] or [None]
        if kind is None:
            return readers.read_table(self.spark, paths, schema, "parquet")
        first, last = self.args.months_range or (None, None)
        selections = [store.Selection(s, first, last) for s in self.args.select or [None]]
        parts = [store.read(self.spark, path, kind, selections) for path in paths]
        return reduce(DataFrame.union, parts)

    def provider(self, paths: list[str], read) -> DataFrame:
        """Raw provider files; with ``--tolerate-corrupt`` those that break off are taken as far as they go, and listed."""
        if not self.args.tolerate_corrupt:
            return read(False)
        account = readers.file_account(self.spark, paths).where("not complete")
        writers.write_report(account, self.path("incomplete_files"), "path")
        return read(True)

    def trades(self) -> DataFrame:
        if self.args.format == "store":
            return self.table(self.args.trades, schemas.TRADES)
        paths = self.args.trades
        return self.provider(paths, lambda tolerate: readers.read_trades(self.spark, paths, self.args.format, tolerate))

    def book(self) -> DataFrame:
        if self.args.format == "store":
            return self.table(self.args.book, store.KINDS["book"].schema)
        paths, symbol = self.args.book, self.args.symbol
        return self.provider(paths, lambda tolerate: readers.read_order_book(self.spark, paths, symbol, self.args.format, tolerate))

    def bars(self) -> DataFrame:
        if self.args.format == "csv":
            return readers.read_arbitrage(self.spark, self.args.bars)
        return self.table(self.args.bars, schemas.ARBITRAGE)

    def rates(self) -> DataFrame:
        return readers.read_rates(self.spark, self.args.rates, "parquet" if self.args.format == "store" else self.args.format)

    def pairs(self) -> list[PairRates]:
        return check_pairs([PairRates(*entry) for entry in json.loads(self.args.pairs)])

    def pair_choice(self, series: DataFrame) -> dict:
        """The chosen pairs, or how to split the work of all pairs of a staged series."""
        if self.args.pairs_list and self.args.symbols:
            raise ValueError("give either --pairs-list or --symbols")
        chosen = json.loads(self.args.pairs_list) if self.args.pairs_list else combinations(self.args.symbols or (), 2)
        if self.args.pairs_list or self.args.symbols:
            return {"pairs": pairing.pair_list(self.spark, chosen)}
        return {"blocks": pairing.symbol_blocks(series)}

    def path(self, job: str, step: str = "") -> str:
        first, last = getattr(self.args, "first", None) or "", getattr(self.args, "last", None) or ""
        return f"{self.args.out.rstrip('/')}/{writers.run_name(job, self.args.label, first, last, step)}"


@job("trades-arbitrage", TRADES, *PERIOD, arg("--seconds", type=int, default=1), arg("--nan-policy", default="propagate"))
def trades_arbitrage(c: Context) -> None:
    a = c.args
    bars = trades.trades_arbitrage(c.trades(), a.seconds, a.first, a.last, a.nan_policy)
    writers.write_sorted(bars, c.path("arbitrage_trades", f"{a.seconds}s"), "start_second", "symbol")


@job("daily-average-price", TRADES, *PERIOD)
def daily_average_price(c: Context) -> None:
    prices = trades.daily_average_price(c.trades(), c.args.first, c.args.last)
    path = c.path("average_daily_price")
    writers.write_twice(prices, f"{path}.csv.gz", f"{path}.csv", "day", "symbol")


@job("time-grid", *PERIOD, MINUTES)
def time_grid(c: Context) -> None:
    a = c.args
    grid = generators.time_grid(c.spark, a.first, a.last, a.minutes)
    writers.write_parts(grid, c.path("complete_minute_sequence", f"{a.minutes}m"), gzip=True)


@job("parity-rate", *PERIOD)
def parity_rate(c: Context) -> None:
    rate = generators.parity_rate(c.spark, c.args.first, c.args.last)
    writers.write_parts(rate, c.path("average_daily_price"), gzip=True)


@job("monthly-measures", BARS, RATES, PAIRS)
def monthly_measures(c: Context) -> None:
    states, rates, pairs = monthly.pair_states(c.bars()), c.rates(), c.pairs()
    writers.write_report(
        monthly.measures_of(states, rates, pairs), c.path("monthly_arbitrage_measures"), "symbol", "year_month"
    )
    daily = monthly.daily_profit_and_volume(states, rates, pairs)
    writers.write_parts(monthly.statistics_of(states, daily), c.path("statistics"))


@job("monthly-measures-usd-pair", BARS, RATES)
def monthly_measures_usd_pair(c: Context) -> None:
    states, rates = monthly.usd_pair_states(c.bars()), c.rates()
    writers.write_report(
        monthly.usd_measures_of(states, rates), c.path("monthly_arbitrage_measures"), "symbol", "year_month"
    )
    writers.write_parts(monthly.statistics_of(states, monthly.daily_volume_own_rate(states, rates)), c.path("statistics"))


@job("zero-filled-stats", BARS, *PERIOD, MINUTES)
def zero_filled_stats(c: Context) -> None:
    a, step = c.args, f"{c.args.minutes}m"
    series = stage(zero_fill.return_series(c.bars(), a.minutes * 60), "series")
    period = (a.first, a.last, a.minutes * 60)
    writers.write_parts(zero_fill.sparse_statistics(series, *period), c.path("statistics", step))
    volatility = zero_fill.sparse_monthly_volatility(series, *period)
    writers.write_report(volatility, c.path("monthly_arbitrage_volatility", step), "symbol", "year_month")


@job("intraday-breakdown", BARS, RATES, PAIRS, *PERIOD, MINUTES)
def intraday_breakdown(c: Context) -> None:
    a = c.args
    bins = intraday.filled_bins(c.bars(), c.rates(), c.pairs(), a.first, a.last, a.minutes * 60)
    bins = stage(bins, "filled-bins")
    order = ("symbol", "start_minute_of_day")
    writers.write_report(intraday.intraday_breakdown(bins), c.path("daily_breakdown_activity", "60m"), *order)
    writers.write_report(intraday.intraday_variance(bins), c.path("daily_breakdown_variance", "60m"), *order)


@job(
    "order-book-series", BARS, arg("--book", required=True, nargs="+", help="snapshot files or globs"),
    arg("--symbol", help="of all snapshots; by default taken from each file's path"), arg("--thin-book", default="extend"),
)
def order_book_series(c: Context) -> None:
    series = order_book.order_book_series(c.book(), c.bars(), 60, c.args.thin_book)
    writers.write_sorted(series, c.path("order_book_and_trades", "1m"), "start_ts_ob", "symbol")


@job(
    "clean-book-series", SERIES, RATES, PAIRS, arg("--outlier-minutes", type=int, default=10),
    arg("--correlations", action="store_true"),
)
def clean_book_series(c: Context) -> None:
    series = c.table(c.args.series, schemas.BOOK_SERIES)
    clean = stage(
        order_book.clean_book_series(series, c.rates(), c.pairs(), c.args.outlier_minutes * 60), "clean-series"
    )
    writers.write_sorted(clean, c.path("clean_order_book_and_trades", "1m"), "start_ts_ob", "symbol")
    writers.write_parts(order_book.clean_book_statistics(clean), c.path("statistics", "1m"))
    if c.args.correlations:
        matrix = correlation.measure_matrix(clean)
        writers.write_report(matrix, c.path("single_pair_correlations"), "symbol", "first", "second")


@job("book-intraday-breakdown", SERIES, *PERIOD, arg("--skip-empty", action="store_true"))
def book_intraday_breakdown(c: Context) -> None:
    a = c.args
    series = c.table(a.series, schemas.BOOK_SERIES)
    breakdown = order_book.book_intraday_breakdown(series, a.first, a.last, skip_empty=a.skip_empty)
    writers.write_report(breakdown, c.path("daily_breakdown", "1m"), "symbol", "start_minute_of_day")


@job("intra-pair-correlation", SERIES, MINUTES)
def intra_pair_correlation(c: Context) -> None:
    clean = c.table(c.args.series, schemas.CLEAN_SERIES)
    table = correlation.with_significance(correlation.intra_pair(clean, c.args.minutes * 60))
    path = c.path("single_pair_correlations", f"{c.args.minutes}m")
    writers.write_report(table.select("symbol", "first", "second", "correlation", "significance"), path, "symbol")


@job("cross-pair-correlation", SERIES, MINUTES, *PAIR_CHOICE)
def cross_pair_correlation(c: Context) -> None:
    wanted = {"start_ts_ob", "symbol", *correlation.CROSS_MEASURES} - {"volatility"}
    clean = stage(c.table(c.args.series, schemas.CLEAN_SERIES).select(*sorted(wanted)), "series")
    correlations = correlation.cross_pair(clean, c.args.minutes * 60, **c.pair_choice(clean))
    table = correlation.with_significance(correlations)
    path = c.path("crosspair_correlations", f"{c.args.minutes}m")
    writers.write_parts(table.select("measure", "first", "second", "correlation", "significance"), path)


@job("lead-lag", SERIES, arg("--keep-sign", action="store_true", help="do not flip the leader's returns"), *PAIR_CHOICE)
def lead_lag(c: Context) -> None:
    clean = stage(c.table(c.args.series, schemas.CLEAN_SERIES).select("start_ts_ob", "symbol", "logreturn"), "series")
    fits = leadlag.lead_lag(clean, [300, 3600], not c.args.keep_sign, **c.pair_choice(clean))
    fits = stage(leadlag.with_p_value(fits), "fits")
    for value in ("beta", "p_value"):
        table = leadlag.lead_lag_table(fits, value)
        writers.write_report(table, c.path(f"lead_lag_{value}"), "leader", "follower", "interval")


@job("triangulation", BARS, arg("--triangle", required=True, action="append", nargs=3, metavar=("CS", "CU", "SU")))
def triangulate(c: Context) -> None:
    series = stage(triangulation.triangulation(c.bars(), [Triangle(*t) for t in c.args.triangle]), "triangles")
    writers.write_parts(series, c.path("triangulation_series"), gzip=True)
    writers.write_report(
        triangulation.triangulation_monthly(series), c.path("triangulation_arbitrage"), "symbol", "year_month"
    )


@job(
    "monthly-tables", arg("--measures", required=True, nargs="+"), arg("--volatility", nargs="+"),
    arg("--months", nargs="+", metavar="YYYY-MM", help="columns of the tables, default all months"),
)
def monthly_tables(c: Context) -> None:
    a = c.args
    table = c.table(a.measures, schemas.MONTHLY_MEASURES)
    tables = dict(reports.SINGLE_PAIR_TABLES)
    if a.volatility:
        table = monthly.combine_monthly(table, c.table(a.volatility, schemas.MONTHLY_VOLATILITY))
        writers.write_report(table, c.path("combined_monthly"), "symbol", "year_month")
    else:
        tables.pop("annualized_monthly_volatility_logreturns")
    months = a.months or reports.month_range(table)
    for column, factor in tables.items():
        pivot = reports.monthly_pivot(table, column, months, factor)
        writers.write_report(pivot, c.path(f"table_{column}"), "symbol")
    writers.write_report(reports.arbitrage_summary(table), c.path("arbitrage_summary"), "symbol")


@job("triangle-tables", arg("--measures", required=True, nargs="+"), arg("--months", nargs="+", metavar="YYYY-MM"))
def triangle_tables(c: Context) -> None:
    table = c.table(c.args.measures, schemas.TRIANGLE_MONTHLY)
    months = c.args.months or reports.month_range(table)
    for column, factor in reports.TRIANGLE_TABLES.items():
        pivot = reports.monthly_pivot(table, column, months, factor)
        writers.write_report(pivot, c.path(f"triangle_table_{column}"), "symbol")
    for side in ("sell", "buy"):
        writers.write_report(reports.arbitrage_summary(table, side), c.path(f"triangle_{side}_summary"), "symbol")


#: Columns a matrix report can sensibly have.
MATRIX_SYMBOLS = 500
CORRELATION_FILES = (
    arg("--file5", required=True, nargs="+", help="correlations at the finer interval"),
    arg("--file60", required=True, nargs="+", help="correlations at the coarser interval"),
    arg("--significance-threshold", type=float),
)


@job("correlation-tables", *CORRELATION_FILES, arg("--threshold", type=float), arg("--symbols", nargs="+", help="rows and columns; by default those of up to 500 instruments in the files"))
def correlation_tables(c: Context) -> None:
    """Cross-pair matrices: the finer interval above the diagonal, the coarser below."""
    a = c.args
    fine, coarse = (c.table(p, schemas.CROSS_CORRELATIONS) for p in (a.file5, a.file60))
    names = fine.select(F.explode(F.array("first", "second")).alias("symbol")).distinct()
    symbols = a.symbols or sorted(row.symbol for row in names.limit(MATRIX_SYMBOLS + 1).collect())
    if len(symbols) > MATRIX_SYMBOLS:
        raise ValueError(f"more than {MATRIX_SYMBOLS} instruments: choose the table's columns by --symbols")
    matrix = reports.correlation_matrix(fine, coarse, symbols, ["measure"], a.threshold, a.significance_threshold)
    for value in ("correlation", "significance"):
        table = reports.matrix_table(matrix, ["measure"], symbols, value)
        writers.write_report(table, c.path(f"cross_pair_{value}_matrix"), "measure", "entity")


@job("single-pair-correlation-tables", *CORRELATION_FILES, arg("--symbols", nargs="+", default=reports.MAIN_PAIRS))
def single_pair_correlation_tables(c: Context) -> None:
    """Measure matrices of each pair: the finer interval below the diagonal, the coarser above."""
    a = c.args
    wanted = F.col("symbol").isin(*a.symbols)
    fine, coarse = (c.table(p, schemas.INTRA_CORRELATIONS).where(wanted) for p in (a.file5, a.file60))
    shown = sorted(set(correlation.INTRA_MEASURES) - set(reports.OMITTED_MEASURES))
    matrix = reports.correlation_matrix(coarse, fine, shown, ["symbol"], None, a.significance_threshold)
    for value in ("correlation", "significance"):
        table = reports.matrix_table(matrix, ["symbol"], shown, value)
        writers.write_report(table, c.path(f"single_pair_{value}_matrix"), "symbol", "entity")


@job("parity-table", arg("--breakdown", required=True, nargs="+"))
def parity_table(c: Context) -> None:
    breakdown = c.table(c.args.breakdown, schemas.INTRADAY_BREAKDOWN)
    writers.write_report(reports.parity_table(breakdown), c.path("price_parity"), "symbol")


@job("breakdown-points", arg("--breakdown", required=True, nargs="+"))
def breakdown_points(c: Context) -> None:
    breakdown = reports.clipped_parity(c.table(c.args.breakdown, schemas.INTRADAY_BREAKDOWN))
    measures = [n for n in breakdown.columns if n not in ("symbol", "start_minute_of_day")]
    points = reports.breakdown_points(breakdown, measures)
    writers.write_report(points, c.path("breakdown_points"), "symbol", "measure", "hour")


@job(
    "plot-series", BARS, arg("--column", required=True), arg("--aggregation", choices=("avg", "max", "min", "sum", "count")),
    arg("--samples", type=int),
)
def plot_series(c: Context) -> None:
    points = reports.plot_series(c.bars(), c.args.column, c.args.aggregation, c.args.samples)
    write = writers.write_report if c.args.samples else writers.write_sorted
    write(points, c.path(f"plot_{c.args.column}"), "symbol", "x")


@job("statistics-tables", arg("--statistics", required=True, nargs="+"))
def statistics_tables(c: Context) -> None:
    statistics = c.table(c.args.statistics, schemas.STATISTICS)
    writers.write_report(reports.statistics_report(statistics), c.path("statistics_report"), "type", "position")


@job(
    "store", arg("--kind", required=True, choices=sorted(store.KINDS)), arg("--input", required=True, nargs="+", help="files or globs"),
    arg("--symbol", help="of order-book snapshots; by default taken from each file's path"),
)
def fill_store(c: Context) -> None:
    """Add files to a store; the months they hold replace what the store had of them."""
    a = c.args
    if a.kind in ("trades", "book"):
        a.trades = a.book = a.input
        table = c.trades() if a.kind == "trades" else c.book()
    else:
        table = c.table(a.input, store.KINDS[a.kind].schema)
    store.write(table, a.store or c.path(f"store_{a.kind}"), a.kind)


#: Results that runs are combined of: schema, and the columns that name a row.
RESULTS = {
    "monthly-measures": (schemas.MONTHLY_MEASURES, ["year_month", "symbol"]),
    "monthly-volatility": (schemas.MONTHLY_VOLATILITY, ["year_month", "symbol"]),
    "triangle-monthly": (schemas.TRIANGLE_MONTHLY, ["year_month", "symbol"]),
    "daily-price": (schemas.DAILY_PRICE, ["day", "symbol"]),
    "statistics": (schemas.STATISTICS, ["type", "symbol"]),
    "intra-correlations": (schemas.INTRA_CORRELATIONS, ["symbol", "first", "second"]),
    "cross-correlations": (schemas.CROSS_CORRELATIONS, ["measure", "first", "second"]),
    "intraday-breakdown": (schemas.INTRADAY_BREAKDOWN, ["start_minute_of_day", "symbol"]),
    "bars": (schemas.ARBITRAGE, ["start_second", "symbol"]),
    "book-series": (schemas.BOOK_SERIES, ["start_ts_ob", "symbol"]),
    "clean-series": (schemas.CLEAN_SERIES, ["start_ts_ob", "symbol"]),
}


@job(
    "combine-runs", arg("--table", required=True, choices=sorted(RESULTS)),
    arg("--runs", required=True, nargs="+", help="result folders or globs; columns a run lacks are null"),
    arg("--all-runs", action="store_true", help="keep every run's rows; by default the newest run's of each key"),
    arg("--parts", action="store_true", help="write gzip parts in order, for large tables; by default one CSV file"),
)
def combine_runs(c: Context) -> None:
    """The results of many runs as one table, with the stamp of the run each row is from."""
    a, (schema, keys) = c.args, RESULTS[c.args.table]
    runs = readers.read_stamped(c.spark, a.runs, schema, keys, a.format)
    table = runs if a.all_runs else readers.newest(runs, keys)
    path = c.path(f"combined_{a.table.replace('-', '_')}")
    (writers.write_sorted if a.parts else writers.write_report)(table, path, *keys, "run")


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="tickloom.jobs", description=__doc__)
    jobs = root.add_subparsers(dest="job", required=True)
    for name, (_, arguments) in JOBS.items():
        sub = jobs.add_parser(name)
        for names, options in arguments:
            sub.add_argument(*names, **options)
        sub.add_argument("--out", required=True)
        sub.add_argument("--label", default="all", help="pair or set of pairs, for the output name")
        sub.add_argument("--format", choices=("csv", "parquet", "store"), default="csv", help="of the tables read; store: as the job store writes")
        sub.add_argument("--select", nargs="+", metavar="SYMBOL", help="read only these symbols of a store")
        sub.add_argument("--months-range", nargs=2, metavar="YYYY-MM", help="read only these months (first and last) of a store")
        sub.add_argument("--tolerate-corrupt", action="store_true", help="take raw files that break off as far as they go, and list them")
        sub.add_argument("--store", help="folder of the store that the job store fills")
        sub.add_argument("--master", default=None)
    return root


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    session = spark or build_session(f"tickloom {args.job}", args.master)
    try:
        with staging_run(session):
            JOBS[args.job][0](Context(session, args, args.job))
    finally:
        if spark is None:
            session.stop()


if __name__ == "__main__":
    main()
