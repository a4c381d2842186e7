"""DuckDB SQL for the registered queries, written from the definitions and independent of the Spark code."""

from __future__ import annotations

from workloads.views import TIE_SHIFT, duckdb_view

DAY_MS = 86_400_000
FIRST_MS = 1_704_067_200_000  # 2024-01-01
END_MS = FIRST_MS + 30 * DAY_MS
HIST_DAYS = "generate_series(timestamp '1995-01-01', timestamp '2001-11-30', interval 1 day)"


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round(({expr}) + {TIE_SHIFT}, {digits}) + 0.0 as {name or expr}"


def rs(*names: str) -> str:
    return ", ".join(r(f'"{n}"', f'"{n}"') for n in names)


def bucket(ms: str, seconds: int) -> str:
    return f"({ms} - ({ms} % {DAY_MS}) % {seconds * 1000})"


def iso(ms: str) -> str:
    return f"strftime(make_timestamp(cast({ms} as bigint) * 1000), '%Y-%m-%dT%H:%M:%SZ')"


def day(ms: str) -> str:
    return f"strftime(make_timestamp(cast({ms} as bigint) * 1000), '%Y-%m-%d')"


def month(ms: str) -> str:
    return f"strftime(make_timestamp(cast({ms} as bigint) * 1000), '%Y-%m')"


def div(num: str, den: str, otherwise: str = "null") -> str:
    return f"(case when {den} = 0 then {otherwise} else {num} / {den} end)"


NAN = "cast('nan' as double)"


def positive(x: str) -> str:
    return f"(not isnan({x}) and {x} > 0)"


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(c.strip() for c in ctes if c) + "\n"


# ---------------------------------------------------------------------------------------------
# bars


def vwap(cond: str = "true") -> str:
    num, den = f"sum(price * amount) filter (where {cond})", f"sum(amount) filter (where {cond})"
    return f"case when coalesce({den}, 0) = 0 then {NAN} else {num} / {den} end"


def exchange_ctes(view: str, seconds: int, where: str = "true") -> list[str]:
    return [
        duckdb_view(view),
        f"""ex as (
  select {bucket('date', seconds)} as start, exchange, symbol,
         count(*) as number_of_trades, {vwap()} as price, sum(amount) as amount,
         sum(case when sell then -amount else amount end) as order_flow,
         {vwap('not sell')} as price_trades_bid, {vwap('sell')} as price_trades_ask,
         coalesce(sum(amount) filter (where not sell), 0) as volume_trades_bid,
         coalesce(sum(amount) filter (where sell), 0) as volume_trades_ask
  from {view} where {where} group by all)""",
    ]


RANGE = f"date between {FIRST_MS} and {END_MS}"


def bars_ctes(view: str, seconds: int, where: str = "true") -> list[str]:
    def at(value: str, price: str, order: str, cond: str, default: str) -> str:
        return f"coalesce(first({value} order by {order}, exchange) filter (where {cond}), {default})"

    ask, bid = "not isnan(price_trades_ask)", positive("price_trades_bid")
    low = ("price_trades_ask", "price_trades_ask", ask)
    high = ("price_trades_bid", "price_trades_bid desc", bid)
    return exchange_ctes(view, seconds, where) + [
        f"""raw_bars as (
  select start, symbol, cast(sum(number_of_trades) as bigint) as total_number_of_trades,
         case when sum(amount) = 0 then {NAN} else sum(price * amount) / sum(amount) end as avg_price,
         sum(amount) as total_volume,
         min(price_trades_ask) as min_price_trades_ask,
         {at('exchange', *low, "''")} as exchange_of_min_price_trades_ask,
         {at('order_flow', *low, '0')} as order_flow_of_min_price_trades_ask,
         {at('volume_trades_ask', *low, '0')} as volume_of_min_price_trades_ask,
         max(price_trades_bid) as max_price_trades_bid,
         {at('exchange', *high, "''")} as exchange_of_max_price_trades_bid,
         {at('order_flow', *high, '0')} as order_flow_of_max_price_trades_bid,
         {at('volume_trades_bid', *high, '0')} as volume_of_max_price_trades_bid,
         sum(order_flow) as total_order_flow
  from ex group by start, symbol)""",
        f"""spread_bars as (
  select *, case when not isnan(min_price_trades_ask) and not isnan(max_price_trades_bid)
                  and exchange_of_min_price_trades_ask <> exchange_of_max_price_trades_bid
                  and max_price_trades_bid - min_price_trades_ask > 0
             then max_price_trades_bid - min_price_trades_ask else 0.0 end as arbitrage_spread
  from raw_bars)""",
        f"""bars as (
  select *, arbitrage_spread * least(volume_of_min_price_trades_ask, volume_of_max_price_trades_bid)
             as arbitrage_profit,
         case when {positive('arbitrage_spread')} then 10000.0 * arbitrage_spread
              / (0.5 * (min_price_trades_ask + max_price_trades_bid)) else 0.0 end as bips,
         start // 1000 as second
  from spread_bars)""",
    ]


BAR_DOUBLES = [
    "avg_price", "total_volume", "min_price_trades_ask", "order_flow_of_min_price_trades_ask",
    "volume_of_min_price_trades_ask", "max_price_trades_bid", "order_flow_of_max_price_trades_bid",
    "volume_of_max_price_trades_bid", "total_order_flow", "arbitrage_spread", "arbitrage_profit",
]
BAR_SELECT = f"""select {iso('start')} as start_second, symbol, total_number_of_trades,
  exchange_of_min_price_trades_ask, exchange_of_max_price_trades_bid, {rs(*BAR_DOUBLES)} from bars"""

NOW_BARS = bars_ctes("fx_trades", 3600, RANGE)
HIST_BARS = bars_ctes("fx_trades_hist", 3600)


# ---------------------------------------------------------------------------------------------
# statistics


def describe(source: str, column: str) -> str:
    """Moments written out; sample deviation, population skewness and excess kurtosis."""
    c = f'"{column}"'
    return f"""select symbol, '{column}' as type, avg(x) as mean, stddev_samp(x) as stddev,
    {div('avg(pow(x - mu, 3))', 'pow(avg(pow(x - mu, 2)), 1.5)')} as skewness,
    {div('avg(pow(x - mu, 4))', 'pow(avg(pow(x - mu, 2)), 2)')} - 3 as kurtosis,
    min(x) as min, max(x) as max,
    avg(case when coalesce(x, 0) = 0 then 1.0 else 0.0 end) as percentage_of_zeros
  from (select symbol, cast({c} as double) as x, avg(cast({c} as double)) over (partition by symbol) as mu
        from {source}) group by symbol"""


STAT_VALUES = ["mean", "stddev", "skewness", "kurtosis", "min", "max", "percentage_of_zeros", "variation_coefficient"]


def describe_all(*pairs: tuple[str, str]) -> str:
    union = " union all ".join(describe(s, c) for s, c in pairs)
    return f"stats as (select *, {div('stddev', 'mean')} as variation_coefficient from ({union}))"


STAT_SELECT = f"select type, symbol, {rs(*STAT_VALUES)} from stats"


# ---------------------------------------------------------------------------------------------
# returns


def first_last(time: str = "second", price: str = "avg_price") -> tuple[str, str]:
    return f"arg_min({price}, {time})", f"arg_max({price}, {time})"


def log_ret(time: str = "second", price: str = "avg_price") -> str:
    a, b = first_last(time, price)
    return f"ln({b} / {a})"


def simple_ret(time: str = "second", price: str = "avg_price") -> str:
    a, b = first_last(time, price)
    return f"({b} - {a}) / {a}"


def cleaned_ctes(seconds: int) -> list[str]:
    return [
        f"""marked as (
  select *, {bucket('start', seconds)} as start_ts from bars where not isnan(avg_price))""",
        """bounded as (
  select *, avg(avg_price) over w as mu, stddev_samp(avg_price) over w as sd
  from marked window w as (partition by symbol, start_ts))""",
        "cleaned as (select * from bounded where avg_price between mu - 3 * sd and mu + 3 * sd)",
    ]


def series_ctes(seconds: int) -> list[str]:
    return cleaned_ctes(seconds) + [
        f"""series as (
  select start_ts, symbol, {log_ret()} as "return", {simple_ret()} as logreturn,
         cast(sum(total_number_of_trades) as double) as total_number_of_trades, avg(avg_price) as avg_price
  from cleaned group by start_ts, symbol)"""
    ]


def filled_ctes(first_ms: str, end_ms: str, seconds: int) -> list[str]:
    return [
        f"""filled as (
  select s.symbol, g.start, coalesce("return", 0) as "return", coalesce(logreturn, 0) as logreturn,
         coalesce(total_number_of_trades, 0) as total_number_of_trades,
         coalesce(avg_price, s.mean_price) as avg_price
  from (select symbol, avg(avg_price) as mean_price from series group by symbol) s
  cross join (select unnest(range({first_ms}, {end_ms}, {seconds * 1000})) as start) g
  left join series f on f.symbol = s.symbol and f.start_ts = g.start)""",
        f"""daily_vol as (
  select {day('start')} as day, symbol, sqrt(sum(logreturn * logreturn)) as daily_volatility_logreturns,
         sqrt(365) * sqrt(sum(logreturn * logreturn)) as annualized_daily_volatility_logreturns
  from filled group by all)""",
        f"""monthly_vol as (
  select {month('start')} as year_month, symbol, sqrt(sum(logreturn * logreturn)) as monthly_volatility_logreturns,
         sqrt(12) * sqrt(sum(logreturn * logreturn)) as annualized_monthly_volatility_logreturns
  from filled group by all)""",
    ]


FILLED = NOW_BARS + series_ctes(21_600) + filled_ctes(str(FIRST_MS), str(END_MS), 21_600)
HIST_FIRST = "(epoch_us(timestamp '1995-01-01') // 1000)"
HIST_END = "(epoch_us(timestamp '2001-12-01') // 1000)"


# ---------------------------------------------------------------------------------------------
# rates and monthly measures


def rate_ctes(view: str, first: str, last: str) -> list[str]:
    return [
        f"""rates as (
  select {day('date')} as day, symbol, sum(price * amount) / sum(amount) as rate
  from {view} where symbol in ('btcusd', 'usdtusd') group by all
  union all
  select strftime(d, '%Y-%m-%d'), 'usdusd', 1.0
  from (select unnest(generate_series(timestamp '{first}', timestamp '{last}', interval 1 day)) as d))""",
        """pairs(symbol, quote_rate, base_rate) as (
  values ('btcusd', 'usdusd', 'btcusd'), ('btcusdt', 'usdtusd', 'btcusd'), ('usdtusd', 'usdusd', 'usdtusd'))""",
    ]


HIST_RATES = rate_ctes("fx_trades_hist", "1995-01-01", "2001-11-30")
NOW_RATES = rate_ctes("fx_trades", "2024-01-01", "2024-01-30")


def returns_ctes(source: str = "bars", where: str = "true", price: str = "avg_price") -> list[str]:
    return [
        f"""rets as (
  select * from (
    select {bucket('start', 86_400)} as start_minute, symbol, {log_ret('second', price)} as "return"
    from {source} where not isnan({price}) and {where} group by all)
  where "return" > -0.5 and "return" < 0.5)""",
        f"""vols as (
  select {month('start_minute')} as year_month, symbol, stddev_samp("return") as volatility_minute_returns,
         sqrt(60 * 24 * 30) * stddev_samp("return") as volatility_minute_returns_monthly
  from rets group by all)""",
    ]


SPREADS = f"""select {month('start')} as year_month, symbol,
    coalesce(avg(bips) filter (where {positive('bips')}), 0) as average_arbitrage_spread_bips,
    count(*) filter (where {positive('bips')}) as number_of_seconds_arbitrage_spread_positive,
    cast(sum(total_number_of_trades) as bigint) as total_number_of_trades,
    avg(avg_price) as avg_price, stddev_samp(avg_price) as stddev_price,
    stddev_samp(avg_price) / avg(avg_price) as ratio_stddev_avg_price,
    sum(arbitrage_profit) as profit_sum
  from bars where not isnan(avg_price)"""

DAILY = f"""daily as (
  select {day('start')} as day, symbol, sum(arbitrage_profit) as daily_arbitrage_profit,
         sum(total_volume) as daily_total_volume from bars group by all)"""

MONTHLY = HIST_BARS + HIST_RATES + returns_ctes() + [
    f"spreads as ({SPREADS} group by all)",
    DAILY,
    """daily_usd as (
  select d.day, d.symbol, q.rate as quote, d.daily_arbitrage_profit * coalesce(q.rate, 1) as profit,
         d.daily_total_volume * coalesce(b.rate, 1) as daily_total_volume_in_usd
  from daily d join pairs p on p.symbol = d.symbol
  left join rates q on q.day = d.day and q.symbol = p.quote_rate
  left join rates b on b.day = d.day and b.symbol = p.base_rate)""",
    """profits as (
  select substr(day, 1, 7) as year_month, symbol, sum(profit) as arbitrage_profit_in_usd,
         avg(quote) as usd_rate_average_price, sum(daily_total_volume_in_usd) as total_volume_in_usd
  from daily_usd group by all)""",
    """measures as (
  select * exclude (profit_sum) from spreads join profits using (year_month, symbol) join vols using (year_month, symbol))""",
]
MONTHLY_USD = HIST_BARS + HIST_RATES + returns_ctes(where="symbol like '%usd'") + [
    f"spreads as ({SPREADS} and symbol like '%usd' group by all)",
    DAILY,
    """daily_usd as (
  select d.day, d.symbol, d.daily_total_volume * coalesce(q.rate, 1) as daily_total_volume_in_usd
  from daily d left join rates q on q.day = d.day and q.symbol = d.symbol where d.symbol like '%usd')""",
    """volumes as (
  select substr(day, 1, 7) as year_month, symbol, sum(daily_total_volume_in_usd) as total_volume_in_usd
  from daily_usd group by all)""",
    """month_rates as (
  select substr(day, 1, 7) as year_month, symbol, avg(rate) as usd_rate_average_price from rates group by all)""",
    """measures as (
  select * exclude (profit_sum), profit_sum as arbitrage_profit_in_usd
  from spreads join month_rates using (year_month, symbol) join volumes using (year_month, symbol)
  join vols using (year_month, symbol))""",
]
MEASURE_SELECT = f"""select year_month, symbol, number_of_seconds_arbitrage_spread_positive, total_number_of_trades,
  {rs('average_arbitrage_spread_bips', 'avg_price', 'stddev_price', 'ratio_stddev_avg_price',
      'arbitrage_profit_in_usd', 'usd_rate_average_price', 'total_volume_in_usd', 'volatility_minute_returns',
      'volatility_minute_returns_monthly')} from measures"""

PRICED = "known as (select * from bars where not isnan(avg_price)),\nusd_known as (select * from known where symbol like '%usd')"


# ---------------------------------------------------------------------------------------------
# intraday

SHARED = ["total_volume_in_usd", "total_number_of_trades", "arbitrage_profit_in_usd"]
INTRADAY = bars_ctes("fx_trades", 1800, RANGE) + NOW_RATES + [
    f"""bins as (
  select {bucket('start', 3600)} as start_ts, symbol, {simple_ret()} as logreturn,
         sum(total_number_of_trades) as total_number_of_trades, sum(total_volume) as v, sum(total_order_flow) as f,
         sum(arbitrage_profit) as p, avg(bips) as bips, avg(avg_price - 1) as price_parity
  from bars where not isnan(avg_price) group by all)""",
    f"""priced as (
  select b.start_ts, b.symbol, b.logreturn, b.total_number_of_trades, b.bips, b.price_parity,
         b.v * coalesce(br.rate, 1) as total_volume_in_usd, b.f * coalesce(br.rate, 1) as total_order_flow_in_usd,
         b.p * coalesce(q.rate, 1) as arbitrage_profit_in_usd
  from bins b join pairs using (symbol)
  left join rates q on q.day = {day('b.start_ts')} and q.symbol = quote_rate
  left join rates br on br.day = {day('b.start_ts')} and br.symbol = base_rate)""",
    f"""bin_grid as (
  select s.symbol, g.start, coalesce(logreturn, 0) as logreturn,
         coalesce(total_number_of_trades, 0) as total_number_of_trades,
         coalesce(total_volume_in_usd, 0) as total_volume_in_usd,
         coalesce(total_order_flow_in_usd, 0) as total_order_flow_in_usd,
         coalesce(arbitrage_profit_in_usd, 0) as arbitrage_profit_in_usd, bips, price_parity
  from (select distinct symbol from priced) s
  cross join (select unnest(range({FIRST_MS}, {END_MS}, 3600000)) as start) g
  left join priced p on p.symbol = s.symbol and p.start_ts = g.start)""",
    f"""hours as (
  select {bucket('start', 21_600)} as g, symbol, sum(total_number_of_trades) as total_number_of_trades,
         sum(total_volume_in_usd) as total_volume_in_usd, sum(total_order_flow_in_usd) as total_order_flow_in_usd,
         sum(arbitrage_profit_in_usd) as arbitrage_profit_in_usd, avg(bips) as bips, avg(price_parity) as parity
  from bin_grid group by all)""",
    f"""days as (
  select {day('start')} as d, symbol, sum(total_number_of_trades) as total_number_of_trades,
         sum(total_volume_in_usd) as total_volume_in_usd, sum(arbitrage_profit_in_usd) as arbitrage_profit_in_usd,
         sum(logreturn * logreturn) as variance
  from bin_grid group by all)""",
    "breakdown as (select (h.g % " + str(DAY_MS) + ") // 60000 as start_minute_of_day, h.symbol, "
    + ", ".join(
        f"avg(case when d.{c} <> 0 then h.{c} / d.{c} else h.{c} end) as avg_{c}_as_daily_percentage" for c in SHARED
    )
    + """, avg(h.total_volume_in_usd) as total_volume_in_usd, avg(h.total_number_of_trades) as total_number_of_trades,
  avg(h.total_order_flow_in_usd) as total_order_flow_in_usd, avg(h.arbitrage_profit_in_usd) as arbitrage_profit_in_usd,
  coalesce(avg(bips), 0) as avg_arbitrage_spread_as_midpoint_bips, coalesce(avg(parity), 0) as avg_price_parity
  from hours h join days d on d.symbol = h.symbol and d.d = """ + day("h.g") + " group by all)",
    f"""variance as (
  select (g % {DAY_MS}) // 60000 as start_minute_of_day, symbol, avg(share) as avg_variance_logreturns_as_daily_percentage,
         avg(v) as variance_logreturns
  from (select {bucket('b.start', 21_600)} as g, b.symbol, sum(logreturn * logreturn) as v,
               sum(case when d.variance <> 0 then logreturn * logreturn / d.variance else logreturn * logreturn end) as share
        from bin_grid b join days d on d.symbol = b.symbol and d.d = {day('b.start')} group by all)
  group by all)""",
]
BREAKDOWN_DOUBLES = [f"avg_{c}_as_daily_percentage" for c in SHARED] + [
    "total_volume_in_usd", "total_number_of_trades", "total_order_flow_in_usd", "arbitrage_profit_in_usd",
    "avg_arbitrage_spread_as_midpoint_bips", "avg_price_parity",
]


# ---------------------------------------------------------------------------------------------
# order book


def snapshot_ctes(view: str, seconds: int) -> list[str]:
    return [
        duckdb_view(view),
        f"""snap as (
  select symbol, {bucket('date', seconds)} as start_ts, type = 'b' as bid, price, amount
  from (select *, min(date) over (partition by symbol, {bucket('date', seconds)}) as first_date from {view})
  where date = first_date)""",
        """top as (
  select *, best_ask - best_bid as bid_ask_spread, (best_ask + best_bid) / 2 as midpoint_ob
  from (select symbol, start_ts, max(price) filter (where bid) as best_bid, min(price) filter (where not bid) as best_ask
        from snap group by all))""",
    ]


def execution_ctes(sizes: str, multipliers: list[float]) -> list[str]:
    values = ", ".join(f"({k})" for k in multipliers)
    return [
        """quotes as (
  select *, case when bid then -price else price end as rank,
         coalesce(sum(amount) over (partition by symbol, start_ts, bid
           order by case when bid then -price else price end, amount
           rows between unbounded preceding and 1 preceding), 0) as before,
         row_number() over (partition by symbol, start_ts, bid
           order by case when bid then -price else price end desc, amount desc) as from_end,
         sum(amount) over (partition by symbol, start_ts, bid) as depth
  from snap)""",
        f"""fills as (
  select s.symbol, s.start_ts, q.bid, k.k as multiplier, k.k * s.size as quantity,
         sum(case when q.before < k.k * s.size then price * least(amount, k.k * s.size - q.before) else 0 end) as deep,
         sum(case when from_end > 1 then price * amount else 0 end)
           + (any_value(k.k * s.size) - any_value(depth)) * max(case when from_end = 1 then price end) as thin,
         any_value(depth) as depth
  from {sizes} s join quotes q using (symbol, start_ts) cross join (values {values}) k(k) group by all)""",
        """executions as (
  select *, case when quantity is null or isnan(quantity) or quantity <= 0 then null
                 when quantity <= depth then deep / quantity else thin / quantity end as execution_price
  from fills)""",
    ]


def book_ctes(view: str, bar_seconds: int, seconds: int) -> list[str]:
    def imbalance(k: int) -> str:
        b = f"(max(execution_price) filter (where bid and multiplier = {k}))"
        a = f"(max(execution_price) filter (where not bid and multiplier = {k}))"
        mid = "any_value(t.midpoint_ob)"
        return f"(({mid} - {b}) - ({a} - {mid})) / (({mid} - {b}) + ({a} - {mid})) as liquidity_imbalance_{k}avg"

    return bars_ctes("fx_trades", bar_seconds, RANGE) + cleaned_ctes(seconds) + snapshot_ctes(view, seconds) + [
        f"""trade_side as (
  select start_ts, symbol, {log_ret()} as "return", {simple_ret()} as logreturn,
         cast(sum(total_number_of_trades) as double) as total_number_of_trades, sum(total_volume) as total_volume,
         avg(avg_price) as avg_price, avg(avg_price - 1) as price_parity, avg(arbitrage_spread) as avg_arbitrage_spread,
         avg(arbitrage_profit) as avg_arbitrage_profit, avg(bips) as avg_arbitrage_spread_as_midpoint_bips,
         sum(total_order_flow) as total_order_flow,
         sum(total_volume) / sum(total_number_of_trades) as avg_trade_size, avg_trade_size as size
  from cleaned group by start_ts, symbol)""",
        *execution_ctes("trade_side", [1.0, 2.0, 3.0]),
        f"""imbalances as (
  select e.symbol, e.start_ts, {imbalance(1)}, {imbalance(2)}, {imbalance(3)}
  from executions e join top t using (symbol, start_ts) group by e.symbol, e.start_ts)""",
        f"""book_series as (
  select t.start_ts as start_ts_ob, t.symbol, bid_ask_spread, midpoint_ob, liquidity_imbalance_1avg,
         liquidity_imbalance_2avg, liquidity_imbalance_3avg, m.* exclude (start_ts, symbol, size),
         2.0 * abs(avg_price - midpoint_ob) as effective_spread_ob, {iso('t.start_ts')} as date_display
  from top t join trade_side m using (symbol, start_ts) left join imbalances i using (symbol, start_ts)
  where bid_ask_spread is not null)""",
    ]


BOOK_DOUBLES = [
    "bid_ask_spread", "midpoint_ob", "liquidity_imbalance_1avg", "liquidity_imbalance_2avg", "liquidity_imbalance_3avg",
    "return", "logreturn", "total_number_of_trades", "total_volume", "avg_price", "price_parity", "avg_trade_size",
    "avg_arbitrage_spread", "avg_arbitrage_profit", "avg_arbitrage_spread_as_midpoint_bips", "total_order_flow",
    "effective_spread_ob",
]
PAIR_BOOK = book_ctes("fx_book_pairs", 1800, 7200)
CLEAN = PAIR_BOOK + NOW_RATES + [
    f"""grouped as (
  select *, avg(bid_ask_spread) over w as mu, stddev_samp(bid_ask_spread) over w as sd
  from book_series window w as (partition by symbol, {bucket('start_ts_ob', 86_400)}))""",
    f"""clean as (
  select g.* exclude (mu, sd), bid_ask_spread / midpoint_ob * 10000 as bid_ask_spread_bps,
         {day('start_ts_ob')} as day, q.symbol as usd_rate, q.rate as usd_rate_average_daily_price,
         total_order_flow * q.rate as total_order_flow_usd, logreturn * logreturn as volatility
  from grouped g join pairs p using (symbol)
  left join rates q on q.day = {day('start_ts_ob')} and q.symbol = p.base_rate
  where bid_ask_spread between mu - 3 * sd and mu + 3 * sd)""",
]
CLEAN_STATISTICS = [
    "bid_ask_spread", "bid_ask_spread_bps", "effective_spread_ob", "total_order_flow", "total_order_flow_usd",
    "avg_arbitrage_spread_as_midpoint_bips",
]


# ---------------------------------------------------------------------------------------------
# correlation


def p_value(t: str, df: str) -> str:
    """Exact two-sided Student-t p-value for whole degrees of freedom, as the finite trigonometric sum."""
    c2 = f"({df} / ({df} + pow({t}, 2)))"
    even = (
        f"sqrt(1 - {c2}) * list_sum(list_transform(range(0, cast({df} // 2 as bigint)), "
        f"lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1.0) + j * ln({c2}))))"
    )
    odd = (
        f"2 / pi() * (atan(abs({t}) / sqrt({df})) + sqrt(1 - {c2}) * sqrt({c2}) * coalesce(list_sum(list_transform("
        f"range(0, cast(({df} - 1) // 2 as bigint)), "
        f"lambda j: exp(lgamma(j + 1.0) + lgamma(1.5) - lgamma(j + 1.5) + j * ln({c2})))), 0))"
    )
    return (
        f"(case when {t} is null or isnan({t}) or {df} <= 0 then null when isinf({t}) then 0.0 "
        f"when {t} = 0 then 1.0 when {df} % 2 = 0 then 1 - {even} else 1 - {odd} end)"
    )


def moments(points: str, keys: str) -> list[str]:
    """Correlations from centred sums, two-pass."""
    return [
        f"""centred as (
  select {keys}, x - avg(x) over w as dx, y - avg(y) over w as dy
  from {points} where x is not null and y is not null window w as (partition by {keys}))""",
        f"""corrs as (
  select *, case when n > 2 then case when abs(correlation) >= 1 then sign(correlation) * cast('inf' as double)
      else correlation * sqrt((n - 2) / (1 - correlation * correlation)) end end as t_statistic
  from (select {keys}, count(*) as n,
          case when count(*) > 1 and sum(dx * dx) > 1e-20 and sum(dy * dy) > 1e-20
               then sum(dx * dy) / sqrt(sum(dx * dx) * sum(dy * dy)) end as correlation
        from centred group by {keys}))""",
    ]


INTRA = [
    "total_volume", "avg_arbitrage_spread", "bid_ask_spread", "effective_spread_ob", "total_order_flow",
    "total_number_of_trades", "logreturn", "volatility",
]
SUMMED = {"logreturn", "total_volume", "volatility", "total_order_flow", "total_number_of_trades"}
CROSS = ["logreturn", "total_volume", "volatility", "bid_ask_spread"]
MATRIX = INTRA + ["avg_arbitrage_profit"]


def coarse(seconds: int, measures: list[str], name: str = "coarse") -> str:
    columns = ", ".join(f"{'sum' if m in SUMMED else 'avg'}({m}) as {m}" for m in measures)
    return f"{name} as (select {bucket('start_ts_ob', seconds)} as ts, symbol, {columns} from clean group by all)"


def intra_points(measures: list[str], source: str) -> str:
    parts = [
        f"select symbol, '{a}' as first, '{b}' as second, cast({a} as double) as x, cast({b} as double) as y from {source}"
        for i, a in enumerate(measures)
        for b in measures[i + 1:]
    ]
    return "points as (" + " union all ".join(parts) + ")"


def cross_points(source: str = "coarse") -> str:
    parts = [
        f"""select '{m}' as measure, a.symbol as first, b.symbol as second, a.{m} as x, b.{m} as y
        from {source} a join {source} b on a.ts = b.ts and a.symbol < b.symbol"""
        for m in CROSS
    ]
    return "points as (" + " union all ".join(parts) + ")"


def significance() -> str:
    return f"case when n = 2 and correlation is not null then 1.0 else {p_value('t_statistic', '(n - 2)')} end"


def prefixed(ctes: list[str], suffix: str, names: list[str]) -> list[str]:
    """The same CTEs under other names."""
    import re

    out = []
    for cte in ctes:
        for name in names:
            cte = re.sub(rf"\b{name}\b", f"{name}_{suffix}", cte)
        out.append(cte)
    return out


def two_speed(points: str, keys: str, measures: list[str]) -> list[str]:
    names = ["coarse", "points", "centred", "corrs"]
    base = [points, *moments("points", keys)]
    return (
        prefixed([coarse(21_600, measures), *base], "fast", names)
        + prefixed([coarse(86_400, measures), *base], "slow", names)
        + [
            f"fast as (select *, {significance()} as significance from corrs_fast)",
            f"slow as (select *, {significance()} as significance from corrs_slow)",
        ]
    )


# ---------------------------------------------------------------------------------------------
# lead-lag


def lead_lag_ctes(intervals: list[int]) -> list[str]:
    lags = ", ".join(
        f"lag(x, {k}) over w as x{k}" for k in range(11)
    )
    long = " union all ".join(
        f"select leader, follower, interval, {k} as lag, x{k} as x, y from usable" for k in range(11)
    )
    steps = ", ".join(f"({s})" for s in intervals)
    return [
        """scored as (
  select start_ts_ob, leader, follower, (x - avg(x) over w) / stddev_samp(x) over w as x,
         (y - avg(y) over w) / stddev_samp(y) over w as y
  from (select a.start_ts_ob, a.symbol as leader, b.symbol as follower, -a.logreturn as x, b.logreturn as y
        from clean a join clean b on a.start_ts_ob = b.start_ts_ob and a.symbol <> b.symbol)
  window w as (partition by leader, follower))""",
        f"""binned as (
  select leader, follower, i.s as interval, start_ts_ob - (start_ts_ob % {DAY_MS}) % (i.s * 1000) as bin,
         sum(x) as x, sum(y) as y
  from scored cross join (values {steps}) i(s) group by all)""",
        """full_bins as (
  select g.leader, g.follower, g.interval, g.bin, coalesce(b.x, 0) as x, coalesce(b.y, 0) as y, b.bin is not null as seen
  from (select leader, follower, interval, unnest(range(min(bin), max(bin) + 1, interval * 1000)) as bin
        from binned group by leader, follower, interval) g
  left join binned b using (leader, follower, interval, bin))""",
        f"""usable as (
  select * from (select *, {lags}, lag(y, 5) over w as y5, row_number() over w as rn
    from full_bins window w as (partition by leader, follower, interval order by bin))
  where seen and rn > 10)""",
        f"""long_rows as ({long.replace(' as x, y from', ' as x, y5 as y from')})""",
        f"""fits as (
  select *, beta / sqrt(case when syy - beta * sxy > 1e-12 * syy then syy - beta * sxy else 0 end / (n - 1) / sxx) as t_statistic
  from (select leader, follower, interval, lag, count(*) as n, {div('sum(x * y)', 'sum(x * x)')} as beta, sum(y * y) as syy,
               sum(x * y) as sxy, sum(x * x) as sxx
        from long_rows group by all))""",
    ]


LABEL = "case when lag = 5 then 't' when lag < 5 then 't+' || (5 - lag) else 't-' || (lag - 5) end"


# ---------------------------------------------------------------------------------------------
# triangulation


def triangle_ctes() -> list[str]:
    columns = [
        "avg_price", "min_price_trades_ask", "max_price_trades_bid", "volume_of_min_price_trades_ask",
        "volume_of_max_price_trades_bid", "total_volume",
    ]
    legs = {"cs": "btcusdt", "cu": "btcusd", "su": "usdtusd"}
    wide = ", ".join(
        f"max(case when symbol = '{s}' then {c} end) as {leg}_{c}" for leg, s in legs.items() for c in columns
    )

    def spread(cs: str, cu: str, su: str, gap: str) -> str:
        legs_known = f"{cs} <> 0 and {cu} <> 0 and {su} <> 0"
        ratio = f"{cu} / {cs}"
        value = gap.format(ratio=ratio, su=su)
        return f"case when {legs_known} and {positive(f'({value})')} then {value} else 0.0 end"

    def volume(cs: str, cu: str, su: str) -> str:
        return (
            f"case when {cs} <> 0 and {cu} <> 0 and {su} <> 0 and cs_avg_price <> 0 "
            f"then least({cs} * cs_avg_price, {cu} * cs_avg_price, {su}) else 0.0 end"
        )

    ask, bid = "min_price_trades_ask", "max_price_trades_bid"
    va, vb = "volume_of_min_price_trades_ask", "volume_of_max_price_trades_bid"
    return [
        f"legs as (select start, {wide} from bars group by start)",
        f"""tri0 as (
  select start, 'btcusdt-btcusd-usdtusd' as symbol, coalesce(cs_avg_price, 0) as avg_crypto_stable_price,
         coalesce(cu_avg_price, 0) as avg_crypto_usd_price, coalesce(su_avg_price, 0) as avg_stable_usd_price,
         {spread(f'cs_{ask}', f'cu_{bid}', f'su_{ask}', '{ratio} - {su}')} as sell_arbitrage_spread,
         {spread(f'cs_{bid}', f'cu_{ask}', f'su_{bid}', '{su} - {ratio}')} as buy_arbitrage_spread,
         {volume(f'cs_{va}', f'cu_{vb}', f'su_{va}')} as sell_volume,
         {volume(f'cs_{vb}', f'cu_{va}', f'su_{vb}')} as buy_volume,
         {volume('cs_total_volume', 'cu_total_volume', 'su_total_volume')} as total_volume
  from legs)""",
        f"""tri as (
  select *, start // 1000 as second, sell_arbitrage_spread * sell_volume as sell_arbitrage_profit,
         buy_arbitrage_spread * buy_volume as buy_arbitrage_profit,
         case when sell_arbitrage_spread > 0 then 10000.0 * sell_arbitrage_spread / avg_stable_usd_price else 0.0 end
           as sell_arbitrage_spread_bips,
         case when buy_arbitrage_spread > 0 then 10000.0 * buy_arbitrage_spread / avg_stable_usd_price else 0.0 end
           as buy_arbitrage_spread_bips
  from tri0)""",
    ]


TRI_DOUBLES = [
    "avg_crypto_stable_price", "avg_crypto_usd_price", "avg_stable_usd_price", "sell_arbitrage_spread",
    "buy_arbitrage_spread", "sell_volume", "buy_volume", "total_volume", "sell_arbitrage_profit",
    "buy_arbitrage_profit", "sell_arbitrage_spread_bips", "buy_arbitrage_spread_bips",
]
_known = positive("avg_stable_usd_price")
TRI_MONTHLY = (
    HIST_BARS
    + triangle_ctes()
    + returns_ctes("tri", _known, "avg_stable_usd_price")
    + [
        f"""tri_months as (
  select {month('start')} as year_month, symbol, sum(sell_arbitrage_profit) as sell_arbitrage_profit_in_usd,
         sum(buy_arbitrage_profit) as buy_arbitrage_profit_in_usd,
         coalesce(avg(sell_arbitrage_spread_bips) filter (where sell_arbitrage_spread_bips > 0), 0)
           as average_sell_arbitrage_spread_bips,
         coalesce(avg(buy_arbitrage_spread_bips) filter (where buy_arbitrage_spread_bips > 0), 0)
           as average_buy_arbitrage_spread_bips,
         count(*) filter (where sell_arbitrage_spread_bips > 0) as number_of_seconds_sell_arbitrage_spread_positive,
         count(*) filter (where buy_arbitrage_spread_bips > 0) as number_of_seconds_buy_arbitrage_spread_positive,
         sum(total_volume * case when {_known} then avg_stable_usd_price else 1 end) as total_volume_in_usd,
         avg(avg_stable_usd_price) filter (where {_known}) as avg_price,
         stddev_samp(avg_stable_usd_price) filter (where {_known}) as stddev_price
  from tri group by all)""",
        """tri_measures as (
  select *, stddev_price / avg_price as ratio_stddev_avg_price from tri_months left join vols using (year_month, symbol))""",
    ]
)


def summary(source: str, side: str = "") -> str:
    infix = f"{side}_" if side else ""
    return f"""select symbol, {r('profits')}, opportunities, {r('spread')},
  {r(f"{div('profits', '(spread * 0.0001)')} * greatest(0, spread * 0.0001 - 0.002)", 'net_profits')}
  {f", '{side}' as side" if side else ""}
  from (select symbol, sum({infix}arbitrage_profit_in_usd) as profits,
          cast(sum(number_of_seconds_{infix}arbitrage_spread_positive) as bigint) as opportunities,
          {div(f"sum(average_{infix}arbitrage_spread_bips * number_of_seconds_{infix}arbitrage_spread_positive)",
               f"sum(number_of_seconds_{infix}arbitrage_spread_positive)")} as spread
        from {source} group by symbol)"""


# ---------------------------------------------------------------------------------------------


def _plot_points(source: str, samples: int) -> str:
    return f"""select symbol, x, {r('y')} from (
    select *, row_number() over (partition by symbol order by x) - 1 as pos, count(*) over (partition by symbol) as n
    from {source}) where pos % (case when n > {samples} then n // {samples} else 1 end) = 0"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}

    q["daily_average_price_hist"] = with_(duckdb_view("fx_trades_hist")) + f"""
select {day('date')} as day, symbol, count(*) as number_of_trades, {r('sum(amount)', 'total_amount')},
       {r('sum(price * amount) / sum(amount)', 'average_daily_price')} from fx_trades_hist group by all"""
    q["exchange_bars"] = with_(*exchange_ctes("fx_trades", 3600)) + f"""
select start, exchange, symbol, number_of_trades, {rs('price', 'amount', 'order_flow', 'price_trades_bid',
    'price_trades_ask', 'volume_trades_bid', 'volume_trades_ask')} from ex"""
    q["trades_arbitrage_bars"] = with_(*NOW_BARS) + BAR_SELECT
    q["trades_arbitrage_hist"] = with_(*bars_ctes("fx_trades_hist", 86_400)) + BAR_SELECT
    best_bid = "max(price_trades_bid) filter (where not isnan(price_trades_bid))"
    q["trades_arbitrage_ignore_nan"] = with_(
        *exchange_ctes("fx_trades", 3600, RANGE),
        f"""quotes as (
  select start, symbol, min(price_trades_ask) as ask, coalesce({best_bid}, {NAN}) as bid,
         coalesce(first(exchange order by price_trades_ask, exchange) filter (where not isnan(price_trades_ask)), '') as ea,
         coalesce(first(exchange order by price_trades_bid desc, exchange) filter (where {positive('price_trades_bid')}), '') as eb
  from ex group by all)""",
    ) + f"""select {iso('start')} as start_second, symbol, {r('bid', 'max_price_trades_bid')},
      {r("case when not isnan(ask) and not isnan(bid) and ea <> eb and bid > ask then bid - ask else 0.0 end",
         'arbitrage_spread')} from quotes"""
    q["open_close_range_return"] = with_(
        duckdb_view("fx_trades"),
        f"""per as (
  select {bucket('date', 21_600)} as start, exchange, symbol, first(price order by date, id) as o,
         last(price order by date, id) as c, min(date) as d1, max(date) as d2 from fx_trades group by all)""",
    ) + f"""select start, symbol, {r('first(o order by d1, exchange)', 'price_open')},
      {r('last(c order by d2, exchange)', 'price_close')},
      {r('(max(c) - min(o)) / min(o)', 'range_return')} from per group by start, symbol"""
    q["time_functions"] = with_(duckdb_view("fx_trades")) + f"""
select id, {iso(bucket('date', 5))} as bucket_iso_5, {bucket('date', 660)} as bucket_ms_660,
  {bucket('date', 180)} // 1000 as bucket_s_180, {bucket('date', 900)} as bucket_s_to_ms_900,
  (date % {DAY_MS}) // 300000 * 5 as minute_of_day_5, (date % {DAY_MS}) // 3600000 * 60 as minute_of_day_60,
  case when date % 1000 = 0 then {iso('date')}
       else replace({iso('date')}, 'Z', '.' || lpad(cast(date % 1000 as varchar), 3, '0') || 'Z') end as instant,
  {day('date')} as day, {day('date')} as day_s, {day('date')} as day_ts, {iso('date - date % 60000')} as minute,
  date // 60000 * 60 as minute_epoch, {month('date')} as month, {month('date')} as month_s, {month('date')} as month_ts,
  {month('date')} as month_day, date as provider_ms from fx_trades"""
    q["time_grid_coverage"] = with_(
        duckdb_view("fx_trades"),
        "counts as (select date - date % 3600000 as start, count(*) as number_of_trades from fx_trades group by all)",
    ) + f"""select g.start, {iso('g.start')} as start_display, number_of_trades
      from (select unnest(range({FIRST_MS}, {END_MS}, 3600000)) as start) g left join counts using (start)"""
    q["parity_rate_coverage"] = with_(
        duckdb_view("fx_trades_hist"),
        f"counts as (select {day('date')} as day, count(*) as number_of_trades from fx_trades_hist group by all)",
    ) + f"""select g.day, 'usdusd' as symbol, 1.0::double as average_daily_price, number_of_trades
      from (select strftime(unnest({HIST_DAYS}), '%Y-%m-%d') as day) g left join counts using (day)"""

    q["descriptive_statistics"] = with_(
        *NOW_BARS, PRICED, describe_all(("known", "avg_price"), ("known", "total_volume"), ("known", "arbitrage_spread"))
    ) + STAT_SELECT
    q["outlier_filter_bars"] = with_(
        *NOW_BARS,
        f"marked as (select *, {bucket('start', 86_400)} as start_ts from bars where not isnan(avg_price))",
    ) + f"""select start_ts, {iso('start')} as start_second, symbol, {r('avg_price')}
      from (select *, avg(avg_price) over w as mu, stddev_samp(avg_price) over w as sd from marked
            window w as (partition by symbol, start_ts)) where abs(avg_price - mu) <= 1.5 * sd"""
    q["anomaly_rules"] = with_(*NOW_BARS) + f"""
select {iso('start')} as start_second, symbol, {rs('avg_price', 'arbitrage_spread')} from bars
where not isnan(avg_price) and not (symbol = 'btcusd' and {day('start')} = '2024-01-15')
  and (symbol <> 'usdtusd' or (avg_price > 1.001 and avg_price < 1.02)) and (symbol <> 'btcusdt' or avg_price < 105)
  and arbitrage_spread > -0.5 and arbitrage_spread < 0.5"""
    q["clip_outliers"] = with_(*NOW_BARS) + f"""
select {iso('start')} as start_second, symbol,
  {r("case when symbol <> 'usdtusd' or abs(p - mu) < 3 * sd then p else mu end", 'avg_price_parity')}
from (select *, avg_price - 1 as p, avg(avg_price - 1) over w as mu, stddev_pop(avg_price - 1) over w as sd
      from bars where not isnan(avg_price) window w as (partition by symbol))"""

    q["monthly_volatility"] = with_(*HIST_BARS, *returns_ctes()) + f"""
select year_month, symbol, {rs('volatility_minute_returns', 'volatility_minute_returns_monthly')} from vols"""
    q["monthly_measures"] = with_(*MONTHLY) + MEASURE_SELECT
    q["monthly_measures_usd_pair"] = with_(*MONTHLY_USD) + MEASURE_SELECT
    q["monthly_statistics"] = with_(
        *MONTHLY, PRICED,
        describe_all(("known", "avg_price"), ("daily_usd", "daily_total_volume_in_usd"), ("rets", "return")),
    ) + STAT_SELECT
    q["monthly_statistics_usd_pair"] = with_(
        *MONTHLY_USD, PRICED,
        describe_all(("usd_known", "avg_price"), ("daily_usd", "daily_total_volume_in_usd"), ("rets", "return")),
    ) + STAT_SELECT
    hist_filled = prefixed(
        bars_ctes("fx_trades_hist", 3600)[1:] + series_ctes(86_400) + filled_ctes(HIST_FIRST, HIST_END, 86_400),
        "z", ["ex", "raw_bars", "spread_bars", "bars", "marked", "bounded", "cleaned", "series"],
    )
    q["combined_monthly"] = with_(*MONTHLY, *hist_filled) + f"""
select year_month, symbol, {rs('avg_price', 'arbitrage_profit_in_usd', 'monthly_volatility_logreturns',
  'annualized_monthly_volatility_logreturns')} from measures left join monthly_vol using (year_month, symbol)"""
    pivot = ", ".join(
        r(f"1e-6 * max(total_volume_in_usd) filter (where year_month = '{mo}')", f"m_{mo[:4]}_{mo[5:]}")
        for mo in (f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13) if f"{y}-{m:02d}" < "2001-12")
    )
    q["monthly_pivot"] = with_(*MONTHLY) + f"select symbol, {pivot} from measures group by symbol"
    q["arbitrage_summary"] = with_(*MONTHLY) + summary("measures")

    q["zero_filled_series"] = with_(*FILLED) + f"""
select symbol, start, {rs('return', 'logreturn', 'total_number_of_trades', 'avg_price')} from filled"""
    q["zero_filled_statistics"] = with_(
        *FILLED,
        describe_all(
            ("series", "avg_price"), ("filled", "return"), ("filled", "logreturn"), ("filled", "total_number_of_trades"),
            ("daily_vol", "annualized_daily_volatility_logreturns"),
        ),
    ) + STAT_SELECT
    q["realized_volatility_daily"] = with_(*FILLED) + f"""
select day, symbol, {rs('daily_volatility_logreturns', 'annualized_daily_volatility_logreturns')} from daily_vol"""
    q["realized_volatility_monthly"] = with_(duckdb_view("fx_trades_hist"), *hist_filled) + f"""
select year_month, symbol, {rs('monthly_volatility_logreturns', 'annualized_monthly_volatility_logreturns')}
from monthly_vol"""

    q["intraday_breakdown"] = with_(*INTRADAY) + f"""
select start_minute_of_day, symbol, {rs(*BREAKDOWN_DOUBLES)} from breakdown"""
    q["intraday_variance_breakdown"] = with_(*INTRADAY) + f"""
select start_minute_of_day, symbol, {rs('avg_variance_logreturns_as_daily_percentage', 'variance_logreturns')}
from variance"""
    q["parity_table"] = with_(*INTRADAY) + f"""
select symbol, {r('min(avg_price_parity)', '"min"')}, {r('max(avg_price_parity)', '"max"')},
  {r('stddev_samp(avg_price_parity)', 'stdev')} from breakdown group by symbol"""
    q["breakdown_points"] = with_(*INTRADAY) + " union all ".join(
        f"select symbol, start_minute_of_day / 60.0::double as hour, '{c}' as measure, {r(c, 'value')} from breakdown"
        for c in ("total_volume_in_usd", "avg_price_parity")
    )
    q["daily_plot_series"] = with_(
        *NOW_BARS,
        f"pts as (select symbol, {iso('start - start % 86400000')} as x, sum(total_volume) as y from bars group by all)",
    ) + _plot_points("pts", 7)
    q["sampled_plot_series"] = with_(
        *NOW_BARS, f"pts as (select symbol, {iso('start')} as x, total_volume as y from bars)"
    ) + _plot_points("pts", 100)

    q["order_book_top"] = with_(*snapshot_ctes("fx_book", 21_600)) + f"""
select symbol, start_ts, {rs('best_bid', 'best_ask', 'bid_ask_spread', 'midpoint_ob')} from top"""
    q["execution_price"] = with_(
        *snapshot_ctes("fx_book", 21_600),
        "sizes as (select distinct symbol, start_ts, ((start_ts // 21600000) % 7) * 10.0::double + 0.25 as size from snap)",
        *execution_ctes("sizes", [1.0, 3.0, 40.0]),
    ) + f"""select symbol, start_ts, bid, cast(multiplier as double) as multiplier, {r('execution_price')}
      from executions"""
    q["liquidity_imbalance"] = with_(*book_ctes("fx_book", 3600, 21_600)) + f"""
select start_ts_ob, symbol, {rs('bid_ask_spread', 'midpoint_ob', 'avg_trade_size', 'liquidity_imbalance_1avg',
    'liquidity_imbalance_2avg', 'liquidity_imbalance_3avg')} from book_series"""
    q["order_book_series"] = with_(*PAIR_BOOK) + f"""
select start_ts_ob, symbol, date_display, {rs(*BOOK_DOUBLES)} from book_series"""
    q["book_clean_series"] = with_(*CLEAN) + f"""
select start_ts_ob, symbol, date_display, day, usd_rate, {rs(*BOOK_DOUBLES, 'bid_ask_spread_bps',
    'usd_rate_average_daily_price', 'total_order_flow_usd')} from clean"""
    q["book_statistics"] = with_(*CLEAN, describe_all(*[("clean", c) for c in CLEAN_STATISTICS])) + STAT_SELECT
    q["book_intraday_breakdown"] = with_(
        *PAIR_BOOK,
        f"""hours as (
  select {bucket('g.start', 21_600)} as h, s.symbol,
         coalesce(avg(effective_spread_ob / midpoint_ob * 10000), 0) as e,
         coalesce(avg(bid_ask_spread / midpoint_ob * 10000), 0) as b
  from (select distinct symbol from book_series) s
  cross join (select unnest(range({FIRST_MS}, {END_MS}, 7200000)) as start) g
  left join book_series x on x.symbol = s.symbol and x.start_ts_ob = g.start group by all)""",
    ) + f"""select (h % {DAY_MS}) // 60000 as start_minute_of_day, symbol, {r('avg(e)', 'effective_spread_as_bps')},
      {r('avg(b)', 'bid_ask_spread_as_bps')} from hours group by 1, 2"""
    values = ["mean", "stddev", "skewness", "kurtosis", "min", "max", "variation_coefficient"]
    q["statistics_report"] = with_(
        *CLEAN, describe_all(*[("clean", c) for c in [*CLEAN_STATISTICS, "total_number_of_trades"]])
    ) + f"""select type, symbol, {rs(*values)},
      {r("case when type = 'total_number_of_trades' then percentage_of_zeros end", 'percentage_of_zeros')},
      case symbol when 'btcusdt' then 1 when 'btcusd' then 4 when 'usdtusd' then 6 end::bigint as position from stats"""

    q["intra_pair_correlation"] = with_(
        *CLEAN, coarse(21_600, INTRA), intra_points(INTRA, "coarse"), *moments("points", "symbol, first, second")
    ) + f"""select symbol, first, second, n, {r('correlation')}, {r('t_statistic', digits=5)},
      {r(significance(), 'significance')} from corrs"""
    q["cross_pair_correlation"] = with_(
        *CLEAN, coarse(21_600, CROSS), cross_points(), *moments("points", "measure, first, second")
    ) + f"""select measure, first, second, n, {r('correlation')}, {r('t_statistic', digits=5)},
      {r(significance(), 'significance')} from corrs"""
    complete = " and ".join(f"{c} is not null" for c in MATRIX)
    q["measure_matrix"] = with_(
        *CLEAN, f"complete as (select * from clean where {complete})", intra_points(MATRIX, "complete"),
        *moments("points", "symbol, first, second"),
    ) + f"select symbol, first, second, {r('correlation')} from corrs"
    q["lead_lag"] = with_(*CLEAN, *lead_lag_ctes([21_600, 43_200])) + f"""
select leader, follower, cast(interval as bigint) as interval, cast(lag as bigint) as lag, {LABEL} as label, n,
  {r('beta')}, {r('t_statistic', digits=5)}, {r(p_value('t_statistic', '(n - 1)'), 'p_value')} from fits"""
    table = ", ".join(
        r(f"max(beta) filter (where lag = {k})", f"t_{'minus' if k > 5 else 'plus'}_{abs(5 - k)}") for k in range(11)
    )
    chosen = "(least(a, b), greatest(a, b)) in (('btcusd', 'usdtusd'), ('btcusdt', 'usdtusd'))"
    q["lead_lag_chosen_pairs"] = with_(*CLEAN, *lead_lag_ctes([21_600])) + f"""
select leader, follower, cast(interval as bigint) as interval, cast(lag as bigint) as lag, {LABEL} as label, n,
  {r('-beta', 'beta')}, {r('-t_statistic', 't_statistic', digits=5)}, {r(p_value('t_statistic', '(n - 1)'), 'p_value')} from fits
where {chosen.replace('(a, b)', '(leader, follower)')}"""
    q["cross_pair_chosen_pairs"] = q["cross_pair_correlation"] + f" where {chosen.replace('(a, b)', '(first, second)')}"
    q["lead_lag_table"] = with_(*CLEAN, *lead_lag_ctes([21_600])) + f"""
select leader, follower, cast(interval as bigint) as interval, {table} from fits group by leader, follower, interval"""

    def cells(upper: str, lower: str, key: str) -> str:
        return f"""select {key}, least(first, second) as entity, greatest(first, second) as other, correlation, significance
        from {upper} union all select {key}, greatest(first, second), least(first, second), correlation, significance
        from {lower}"""

    q["correlation_matrix"] = with_(*CLEAN, *two_speed(cross_points(), "measure, first, second", CROSS)) + f"""
select measure, entity, other, {r('case when abs(correlation) >= 0.02 then correlation end', 'correlation')},
  {r('case when significance < 0.5 then significance end', 'significance')} from ({cells('fast', 'slow', 'measure')})
union all
select measure, s, s, 1.0, 0.0 from (select distinct measure from fast)
cross join (values ('btcusd'), ('btcusdt'), ('usdtusd')) v(s)"""
    shown = sorted(set(INTRA) - {"avg_arbitrage_spread", "effective_spread_ob"})
    columns = ", ".join(
        r(f"case when entity = '{c}' then 1.0 else max(correlation) filter (where other = '{c}') end", c) for c in shown
    )
    q["single_pair_matrix"] = with_(
        *CLEAN, *two_speed(intra_points(INTRA, "coarse"), "symbol, first, second", INTRA)
    ) + f"select symbol, entity, {columns} from ({cells('slow', 'fast', 'symbol')}) where entity in (" + ", ".join(
        f"'{c}'" for c in shown
    ) + ") group by symbol, entity"

    q["triangulation_bars"] = with_(*bars_ctes("fx_trades", 14_400, RANGE), *triangle_ctes()) + f"""
select {iso('start')} as start_second, symbol, {rs(*TRI_DOUBLES)} from tri"""
    q["triangulation_monthly"] = with_(*TRI_MONTHLY) + f"""
select year_month, symbol, number_of_seconds_sell_arbitrage_spread_positive,
  number_of_seconds_buy_arbitrage_spread_positive, {rs('sell_arbitrage_profit_in_usd', 'buy_arbitrage_profit_in_usd',
  'average_sell_arbitrage_spread_bips', 'average_buy_arbitrage_spread_bips', 'total_volume_in_usd', 'avg_price',
  'stddev_price', 'ratio_stddev_avg_price', 'volatility_minute_returns', 'volatility_minute_returns_monthly')}
from tri_measures"""
    q["triangle_summary"] = (
        with_(*TRI_MONTHLY) + summary("tri_measures", "sell") + " union all " + summary("tri_measures", "buy")
    )
    q["trades_files"] = with_(duckdb_view("fx_trades")) + f"""
select id, exchange, symbol, date, {rs('price', 'amount')}, sell from fx_trades"""
    q["arbitrage_files"] = with_(*NOW_BARS, f"shown as ({BAR_SELECT})") + " select shown.*, copy from shown, (values ('csv'), ('csv.gz')) v(copy)"
    q["book_series_files"] = q["order_book_series"]
    q["time_grid_files"] = q["time_grid_coverage"]
    daily_price = f"""select {day('date')} as day, symbol, count(*) as number_of_trades, sum(amount) as total_amount,
      sum(price * amount) / sum(amount) as average_daily_price"""
    q["rates_by_name"] = with_(duckdb_view("fx_trades_hist")) + f"""
select day, symbol, {r('average_daily_price')} from ({daily_price} from fx_trades_hist group by all)
union all select strftime(unnest({HIST_DAYS}), '%Y-%m-%d'), 'usdusd', 1.0::double"""
    late = "day >= '1998'"
    q["combined_runs"] = with_(duckdb_view("fx_trades_hist")) + f"""
select day, symbol, number_of_trades, {r(f"case when {late} then null else total_amount end", 'total_amount')},
  {r(f"average_daily_price * case when {late} then 2 else 1 end", 'average_daily_price')},
  case when {late} then '2021-05-06__07-08-09' else '2020-05-06__07-08-09' end as run
from ({daily_price} from fx_trades_hist group by all)"""
    q["file_accounts"] = with_(duckdb_view("fx_trades")) + "select count(*) as number_of_trades, 0::bigint as incomplete_files from fx_trades"
    q["store_selection"] = with_(duckdb_view("fx_trades_hist")) + f"""
select day, symbol, number_of_trades, {rs('total_amount', 'average_daily_price')} from ({daily_price} from fx_trades_hist
where (symbol = 'btcusd' and {month('date')} between '1996-01' and '1996-06')
  or (symbol = 'usdtusd' and {month('date')} >= '2000-10') group by all)"""
    q["book_store"] = q["order_book_top"]
    q["spread_caps"] = with_(*snapshot_ctes("fx_book_capped", 21_600)) + f"""
select symbol, start_ts, {rs('best_bid', 'best_ask', 'bid_ask_spread', 'midpoint_ob')} from top
where bid_ask_spread < case symbol when 'btcdai' then 1000.0 else 1.0 end"""
    q["period_by_arguments"] = with_(duckdb_view("fx_trades")) + f"""
select {day('date')} as day, symbol, count(*) as number_of_trades, '2024-01-20' as end_day from fx_trades
where date >= epoch_ms(timestamp '2024-01-05 04:30:00.25') and date < epoch_ms(timestamp '2024-01-20') group by all"""
    q["constant_columns"] = with_(duckdb_view("fx_trades")) + f"""
select symbol, {day('date')} as day, count(*) as number_of_trades from fx_trades group by all"""
    return q


ORACLES = build()
