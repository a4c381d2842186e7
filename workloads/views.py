"""Market tables derived from the driver's tables, once for Spark and once for DuckDB.

Each view is one SQL text; only the three fragments that differ between the dialects are filled in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import use_utc

SPARK = {
    "STR": "string",
    "MS_TS": "unix_millis(cast(ts as timestamp))",
    "MS_SHIP": "unix_millis(cast(l_shipdate as timestamp))",
    "K": "cast(get_json_object(props, '$.k') as double)",
}
DUCKDB = {
    "STR": "varchar",
    "MS_TS": "(epoch_us(ts) // 1000)",
    "MS_SHIP": "(epoch_us(l_shipdate) // 1000)",
    "K": "cast(json_extract(props, '$.k') as double)",
}

SYMBOL = "case user_id % 3 when 0 then 'btcusd' when 1 then 'btcusdt' else 'usdtusd' end"

VIEWS = {
    # intraday trades: three symbols on two exchanges over January 2024
    "fx_trades": (
        "events",
        f"""select cast(event_id as {{STR}}) as id,
       concat('ex', cast(event_id % 2 as {{STR}})) as exchange,
       {SYMBOL} as symbol,
       {{MS_TS}} as date,
       case user_id % 3 when 0 then 100 + value / 50 when 1 then 100 + value / 40 else 1 + value / 5000 end as price,
       {{K}} as amount,
       event_type in ('error', 'purchase') as sell
from {{source}}""",
    ),
    # seven years of trades, for monthly work
    "fx_trades_hist": (
        "lineitem",
        """select concat(cast(l_orderkey as {STR}), '-', cast(l_linenumber as {STR})) as id,
       concat('ex', cast(l_suppkey % 2 as {STR})) as exchange,
       case l_partkey % 3 when 0 then 'btcusd' when 1 then 'btcusdt' else 'usdtusd' end as symbol,
       {MS_SHIP} + (l_orderkey % 86400) * 1000 as date,
       case l_partkey % 3 when 2 then 1 + l_discount / 100 else 100 + 10 * l_discount + l_tax end as price,
       l_quantity as amount,
       l_linestatus = 'F' as sell
from {source}""",
    ),
    # two-sided snapshots every two hours, of one instrument
    "fx_book": (
        "events",
        """select 'btcusd' as symbol,
       {MS_TS} - {MS_TS} % 7200000 as date,
       case when event_id % 2 = 0 then 'b' else 'a' end as type,
       case when event_id % 2 = 0 then 100 - value / 50 else 100.5 + value / 50 end as price,
       {K} + 1 as amount
from {source}""",
    ),
    # the same with one book per symbol
    "fx_book_pairs": (
        "events",
        f"""select {SYMBOL} as symbol,
       {{MS_TS}} - {{MS_TS}} % 7200000 as date,
       case when event_id % 2 = 0 then 'b' else 'a' end as type,
       case when user_id % 3 = 2
            then case when event_id % 2 = 0 then 1 - value / 5000 else 1.005 + value / 5000 end
            else case when event_id % 2 = 0 then 100 - value / 50 else 100.5 + value / 50 end end as price,
       {{K}} + 1 as amount
from {{source}}""",
    ),
    # books of capped symbols, with spreads on both sides of their caps
    "fx_book_capped": (
        "events",
        """select case user_id % 3 when 0 then 'paxusd' when 1 then 'tusdusdt' else 'btcdai' end as symbol,
       {MS_TS} - {MS_TS} % 7200000 as date,
       case when event_id % 2 = 0 then 'b' else 'a' end as type,
       (case when user_id % 3 = 2 then 1000 else 1 end)
         * (case when event_id % 2 = 0 then 100 - value / 50 else 100.5 + value / 50 end) as price,
       {K} + 1 as amount
from {source}""",
    ),
}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    table, text = VIEWS[name]
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(text.format(source="{source}", **SPARK), source=source)


def duckdb_view(name: str) -> str:
    table, text = VIEWS[name]
    return f"{name} as ({text.format(source=table, **DUCKDB)})"


# Added before rounding: a decimal exactly halfway would otherwise round by its summation order.
TIE_SHIFT = 2.3456e-9


def comparable(df: DataFrame, digits: int = 6, **column_digits: int) -> DataFrame:
    """Result types on which both engines agree: rounded doubles, 64-bit integers, ISO strings."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.round(c + F.lit(TIE_SHIFT), column_digits.get(name, digits)) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        columns.append(c.alias(name))
    return df.select(*columns)
