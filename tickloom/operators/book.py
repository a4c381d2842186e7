"""Order-book snapshots: selection, top of book and depth-weighted execution prices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.measures import ieee_ratio, number
from tickloom.functions.timeexpr import bucket_ms
from tickloom.operators.prefilter import likely_in
from tickloom.session import stage

GROUP = ["symbol", "start_ts"]
SIDE = [*GROUP, "bid"]


def snapshot_times(book: DataFrame, seconds: int) -> DataFrame:
    """Earliest snapshot per (symbol, bucket): a map-side-combined pass over two columns."""
    return (
        book.select("symbol", "date", bucket_ms(F.col("date"), seconds).alias("start_ts"))
        .groupBy(*GROUP)
        .agg(F.min("date").alias("date"))
    )


def snapshot_levels(book: DataFrame, times: DataFrame) -> DataFrame:
    """Price levels of the wanted snapshots: one row per (symbol, bucket, side, price).

    ``times``, a staged table, holds one row per wanted snapshot. Other snapshots are left out at the scan, so that the
    join moves little more than what it keeps, whichever way the planner picks for it. Equal prices are merged while
    still map-side; the largest single quote of a level is kept because a thin book needs it.
    """
    wanted = times.select(*GROUP, "date")
    return (
        likely_in(book, wanted, ["symbol", "date"]).join(wanted, ["symbol", "date"])
        .select(
            *GROUP,
            F.coalesce(F.col("type") == "b", F.lit(False)).alias("bid"),
            number(F.col("price")).alias("price"),
            number(F.col("amount")).alias("amount"),
        )
        .groupBy(*SIDE, "price")
        .agg(F.sum("amount").alias("amount"), F.max("amount").alias("largest"))
    )


def top_of_book(levels: DataFrame) -> DataFrame:
    """Best prices, spread and midpoint; the last two are null when a side is empty."""
    return (
        levels.groupBy(*GROUP)
        .agg(
            F.max(F.when(F.col("bid"), F.col("price"))).alias("best_bid"),
            F.min(F.when(~F.col("bid"), F.col("price"))).alias("best_ask"),
        )
        .withColumn("bid_ask_spread", F.col("best_ask") - F.col("best_bid"))
        .withColumn("midpoint_ob", 0.5 * (F.col("best_bid") + F.col("best_ask")))
    )


def banded_levels(levels: DataFrame) -> DataFrame:
    """Levels with their distance from the best price (``rank``) and a ``band`` number, as a staged table.

    Bands are the tasks of one range shuffle, so they are about equally full whatever the prices
    look like: an ordinary side lies in one or two bands, a huge side spreads over many. Staging
    fixes the numbering for every later read.
    """
    ranked = levels.withColumn("rank", F.when(F.col("bid"), -F.col("price")).otherwise(F.col("price")))
    spread = ranked.repartitionByRange(*[F.col(c) for c in SIDE], F.col("rank"))
    return stage(spread.withColumn("band", F.spark_partition_id()), "book-levels")


def side_bands(levels: DataFrame) -> DataFrame:
    """Totals per band, the amount before it, and the side's own totals on each of its bands.

    The windows run over a side's bands, of which there are no more than the range shuffle had tasks.
    """
    ordered = Window.partitionBy(*SIDE).orderBy("band")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bands = levels.groupBy(*SIDE, "band").agg(
        F.sum("amount").alias("band_amount"),
        F.sum(F.col("price") * F.col("amount")).alias("band_notional"),
        F.min("rank").alias("band_best"),
        F.max_by("price", "rank").alias("band_last_price"),
        F.max_by("largest", "rank").alias("band_last_amount"),
    )
    return bands.select(
        *SIDE, "band", "band_amount", "band_notional",
        F.coalesce(F.sum("band_amount").over(earlier), F.lit(0.0)).alias("before"),
        F.sum("band_amount").over(whole).alias("depth"),
        F.sum("band_notional").over(whole).alias("notional"),
        F.first("band_best").over(whole).alias("best_rank"),
        F.last("band_last_price").over(whole).alias("last_price"),
        F.last("band_last_amount").over(whole).alias("last_amount"),
    )


def execution_prices(
    levels: DataFrame, sizes: DataFrame, multipliers: list[float], thin_book: str = "extend"
) -> DataFrame:
    """Per book side: best price, and the average price of trading ``multiplier * size`` against it.

    ``levels`` come from :func:`banded_levels`; ``sizes`` has one ``size`` per (symbol, start_ts).
    Output: symbol, start_ts, bid, best_price and one ``execution_price_<multiplier>`` each. A
    non-positive or unknown quantity gives null. When the side holds less than the quantity, the
    last quote's own amount is dropped and all that is missing is priced at the last level
    (``thin_book="extend"``), or the price is null (``"null"``).

    Quantities are accumulated in two steps, so a huge side never passes through one task: first
    over the bands' totals, then, level by level, over only those bands in which some quantity
    runs out.
    """
    if thin_book not in ("extend", "null"):
        raise ValueError(f"unknown thin_book {thin_book!r}")
    names = {k: f"{k:g}" for k in map(float, multipliers)}
    quantity = {k: F.lit(k) * F.col("size") for k in names}
    band_end = F.col("before") + F.col("band_amount")
    runs_out = {k: (F.col("before") < q) & (q < band_end) for k, q in quantity.items()}

    bands = side_bands(levels).join(sizes.select(*GROUP, "size"), GROUP)

    # Levels of the bands in which a quantity runs out; bands before are used whole, later ones not at all.
    some = reduce(lambda a, b: a | b, runs_out.values())
    opened = bands.where(some).select(*SIDE, "band", "before", "band_amount", "size")
    nearer = Window.partitionBy(*SIDE, "band").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    above = F.col("before") + F.coalesce(F.sum("amount").over(nearer), F.lit(0.0))
    stepped = levels.join(opened, [*SIDE, "band"]).withColumn("above", above)

    def taken(k: float) -> Column:
        used = F.greatest(F.lit(0.0), F.least(F.col("amount"), quantity[k] - F.col("above")))
        return F.sum(F.when(runs_out[k], F.col("price") * used))

    partial = stepped.groupBy(*SIDE).agg(*[taken(k).alias(f"partial_{n}") for k, n in names.items()])
    constants = ["best_rank", "depth", "notional", "last_price", "last_amount", "size"]
    sides = bands.groupBy(*SIDE).agg(
        *[F.max(c).alias(c) for c in constants],
        *[F.sum(F.when(quantity[k] >= band_end, F.col("band_notional"))).alias(f"whole_{n}") for k, n in names.items()],
    )

    last_price = F.col("last_price")

    def price(k: float) -> Column:
        q = quantity[k]
        spent = F.coalesce(F.col(f"`whole_{names[k]}`"), F.lit(0.0)) + F.coalesce(F.col(f"`partial_{names[k]}`"), F.lit(0.0))
        thin = F.lit(None).cast("double")
        if thin_book == "extend":
            thin = F.col("notional") - last_price * F.col("last_amount") + (q - F.col("depth")) * last_price
        valid = ~F.isnan(q) & (q > 0)
        return F.when(valid, F.try_divide(F.when(q <= F.col("depth"), spent).otherwise(thin), q))

    best = F.when(F.col("bid"), -F.col("best_rank")).otherwise(F.col("best_rank")).alias("best_price")
    return sides.join(partial, SIDE, "left").select(
        *SIDE, best, *[price(k).alias(f"execution_price_{n}") for k, n in names.items()]
    )


def imbalance(bid_price: Column, ask_price: Column, midpoint: Column) -> Column:
    """(buy cost - sell cost) / (buy cost + sell cost), each cost measured from the midpoint."""
    buy, sell = midpoint - bid_price, ask_price - midpoint
    return F.when((buy + sell).isNotNull(), ieee_ratio(buy - sell, buy + sell))


def book_measures(
    levels: DataFrame, sizes: DataFrame, multipliers: list[float], thin_book: str = "extend"
) -> DataFrame:
    """Spread, midpoint and ``liquidity_imbalance_<k>avg`` per (symbol, bucket), all from one pass of side totals."""
    sides = execution_prices(levels, sizes, multipliers, thin_book)
    values = {"best": "best_price", **{f"{float(k):g}": f"execution_price_{float(k):g}" for k in multipliers}}

    def of(bid: bool, column: str) -> Column:
        return F.max(F.when(F.col("bid") == F.lit(bid), F.col(f"`{column}`")))

    wide = sides.groupBy(*GROUP).agg(
        *[of(True, c).alias(f"bid_{n}") for n, c in values.items()],
        *[of(False, c).alias(f"ask_{n}") for n, c in values.items()],
    )
    midpoint = 0.5 * (F.col("bid_best") + F.col("ask_best"))
    return wide.withColumn("midpoint_ob", midpoint).select(
        *GROUP,
        (F.col("ask_best") - F.col("bid_best")).alias("bid_ask_spread"),
        "midpoint_ob",
        *[
            imbalance(F.col(f"`bid_{n}`"), F.col(f"`ask_{n}`"), F.col("midpoint_ob")).alias(f"liquidity_imbalance_{n}avg")
            for n in list(values)[1:]
        ],
    )
