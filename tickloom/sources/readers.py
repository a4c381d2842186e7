"""Table scans. Every reader takes a path, a glob or a list of either, as CSV(.gz) or Parquet."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources import schemas

#: pair / month / provider_pair_ob_10_rest
ORDER_BOOK_FILE = r"/([^/]+)/[^/]+/[^/]*_\1_ob_10_[^/]*$"
INSTANT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX"


def read_table(
    spark: SparkSession, path: str | list[str], schema: T.StructType, fmt: str = "csv", tolerate_corrupt: bool = False
) -> DataFrame:
    """Scan with a fixed schema. An unreadable file is an error.

    With ``tolerate_corrupt``, meant for raw provider files, the readable rows of such files are taken and the rest is
    passed over; ``skipped_files`` tells which files gave nothing.
    """
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", str(tolerate_corrupt).lower())
    if fmt == "csv":
        reader = reader.option("header", True).option("timestampFormat", INSTANT_FORMAT)
    return reader.format(fmt).load(path)


def skipped_files(spark: SparkSession, path: str | list[str], schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Files behind ``path`` of which a tolerant scan takes no row."""
    name = F.regexp_replace("path", "^file:/+", "/").alias("path")
    listed = spark.read.format("binaryFile").load(path).select(name)
    read = read_table(spark, path, schema, fmt, True).select(F.col("_metadata.file_path").alias("path")).distinct().select(name)
    return listed.join(read, "path", "left_anti")


def _file() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")


def file_account(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """What a tolerant scan of CSV(.gz) files takes of each: path, rows, bytes_read, bytes_expected, complete.

    A file that breaks off gives its rows up to there and is not complete. Bytes are those of the unpacked text; a gzip
    file tells their number modulo 2^32 in its last four bytes (of its last member, where there are several: such a
    file counts as incomplete). Rows are lines with content but the header. Files of no length are not listed.
    """
    lines = spark.read.option("ignoreCorruptFiles", "true").option("lineSep", "\n").text(path)
    full = F.length(F.trim(F.translate("value", "\r", ""))) > 0
    taken = lines.groupBy(_file().alias("path")).agg(
        F.greatest(F.count_if(full) - 1, F.lit(0)).alias("rows"), F.sum(F.octet_length("value").cast("long") + 1).alias("bytes_read")
    )
    last = lambda i: F.conv(F.hex(F.substring("content", -i, 1)), 16, 10).cast("long")
    told = reduce(lambda a, b: a * 256 + b, [last(i) for i in (1, 2, 3, 4)])
    name = F.regexp_replace("path", "^file:/+", "/").alias("path")
    packed = F.col("path").endswith(".gz")
    size = F.when(~packed, F.col("length")).when(F.col("length") >= 18, told).otherwise(F.lit(-1))
    files = spark.read.format("binaryFile").load(path).select(name, packed.alias("packed"), size.alias("bytes_expected"))
    read = F.when(F.col("packed"), F.pmod("bytes_read", F.lit(1 << 32))).otherwise(F.col("bytes_read"))
    # the last line may end without a line feed
    whole = (read == F.col("bytes_expected")) | (read == F.col("bytes_expected") + 1)
    return files.join(taken, "path", "left").select(
        "path", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("bytes_read", F.lit(0)).alias("bytes_read"), "bytes_expected",
        F.coalesce(whole, F.lit(False)).alias("complete"),
    )


def _named_columns(frame: DataFrame, schema: T.StructType, required: list[str]) -> list[Column]:
    if lost := [n for n in required if n not in frame.columns]:
        raise ValueError(f"columns {lost} are missing where the header is {frame.columns}")
    return [(F.col(f"`{f.name}`") if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]


def read_named(
    spark: SparkSession, path: str | list[str], schema: T.StructType, required: list[str], fmt: str = "csv", **more: Column
) -> DataFrame:
    """One typed table from files with different headers: columns are bound by name, and absent ones are null.

    A file without one of the ``required`` columns is an error, unknown columns are left out. After a look at the first
    lines, CSV files are read once for each different header, however many files there are. ``more``: further columns,
    from ``_metadata``.
    """
    extra = [c.alias(n) for n, c in more.items()]
    if fmt != "csv":
        frame = spark.read.option("mergeSchema", True).format(fmt).load(path)
        return frame.select(*_named_columns(frame, schema, required), *extra)
    kinds = {f.name: f.dataType for f in schema.fields}
    file = F.col("_metadata.file_path")
    lines = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0).select(file.alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    headers: dict[str, list[str]] = {}
    for row in lines.groupBy("file").agg(F.min_by("value", "at").alias("header")).collect():  # one short row per file
        headers.setdefault(row["header"].strip(), []).append(row["file"])
    if not headers:
        raise ValueError(f"nothing to read under {path}")
    parts = []
    for header, files in sorted(headers.items()):
        typed = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in next(csv.reader([header]))])
        reader = spark.read.schema(typed).option("header", True).option("enforceSchema", False).option("timestampFormat", INSTANT_FORMAT)
        frame = reader.csv(sorted(files))
        parts.append(frame.select(*_named_columns(frame, schema, required), *extra))
    return reduce(DataFrame.unionByName, parts)


def read_rates(spark: SparkSession, path: str | list[str], fmt: str = "csv") -> DataFrame:
    """Daily prices and parity rates, whatever other columns they have."""
    rates = read_named(spark, path, schemas.PARITY_RATE, schemas.PARITY_RATE.names, fmt)
    return rates.withColumn("day", F.substring("day", 1, 10))


#: ``run_name``'s time stamp at the beginning of a run's folder.
RUN_STAMP = r"/(\d{4}-\d\d-\d\d__\d\d-\d\d-\d\d)_[^/]*/[^/]*$"


def read_stamped(spark: SparkSession, paths: list[str], schema: T.StructType, required: list[str], fmt: str = "csv") -> DataFrame:
    """The tables of many runs, bound by name, with ``run``: the stamp of the run's folder ("" where there is none)."""
    run = F.regexp_extract(F.col("_metadata.file_path"), RUN_STAMP, 1)
    return read_named(spark, paths, schema, required, fmt, run=run)


def newest(runs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: that of the newest run, and the greatest row where a run holds several."""
    rest = [c for c in runs.columns if c not in {*keys, "run"}]
    best = runs.groupBy(*keys).agg(F.max(F.struct("run", *rest)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in runs.columns])


def read_trades(spark, path, fmt="csv", tolerate_corrupt=False):
    return read_table(spark, path, schemas.TRADES, fmt, tolerate_corrupt)


def read_order_book(spark, path, symbol: str | None = None, fmt="csv", tolerate_corrupt=False):
    """Snapshots in long form. The rows carry no instrument: it is ``symbol``, or else taken from each file's path.

    In the provider layout (``order_book_glob``) the instrument is the folder above the month, and part of the name.
    """
    book = read_table(spark, path, schemas.ORDER_BOOK, fmt, tolerate_corrupt)
    if symbol:
        return book.withColumn("symbol", F.lit(symbol))
    return book.withColumn("symbol", F.regexp_extract(F.col("_metadata.file_path"), ORDER_BOOK_FILE, 1))


def read_arbitrage(spark, path, fmt="csv"):
    """Bars. Where an instant has no quote the exchange is the empty name, which CSV files can't tell from null."""
    bars = read_table(spark, path, schemas.ARBITRAGE, fmt)
    return bars.na.fill("", ["exchange_of_min_price_trades_ask", "exchange_of_max_price_trades_bid"])


def read_daily_price(spark, path, fmt="csv"):
    return read_table(spark, path, schemas.DAILY_PRICE, fmt)


def read_parity_rate(spark, path, fmt="csv"):
    return read_table(spark, path, schemas.PARITY_RATE, fmt)


def read_time_grid(spark, path, fmt="csv"):
    return read_table(spark, path, schemas.TIME_GRID, fmt)


def read_book_series(spark, path, clean=False, fmt="csv"):
    return read_table(spark, path, schemas.CLEAN_SERIES if clean else schemas.BOOK_SERIES, fmt)


def read_runs(spark, paths: list[str], schema: T.StructType, fmt="csv"):
    """All runs behind several paths or globs as one table."""
    return read_table(spark, list(paths), schema, fmt)


def trades_glob(root: str, pair: str = "*") -> str:
    """Provider layout: exchange / pair / month / file."""
    return f"{root.rstrip('/')}/*/{pair}/*/*_{pair}_trades_*.gz"


def order_book_glob(root: str, pair: str = "*") -> str:
    return f"{root.rstrip('/')}/{pair}/*/*_{pair}_ob_10_*.gz"


def select_months(df: DataFrame, pair: str, from_month: str, to_month: str) -> DataFrame:
    """Rows of one pair and an inclusive month range.

    On a table partitioned by (symbol, year_month) this prunes directories.
    """
    if from_month > to_month:
        raise ValueError(f"month range {from_month}..{to_month} is reversed")
    return df.where((F.col("symbol") == pair) & F.col("year_month").between(from_month, to_month))
