"""Operators as declarative plans: common table expressions that both engines read."""

from __future__ import annotations

from ..functions.values import BOLLINGER_SCORES, CAP_TIERS, PCR_SCORES, RSI_SCORES, STOCHASTIC_SCORES, WEIGHTS, WILLIAMS_SCORES, ZSCORE_SCORES
from .dialect import Spark

BLOCK = 2048  # rows after which an exponential mean is anchored anew, so that no power overflows

def steps(value: str, op: str, table, beyond: float, missing: float | None = None) -> str:
    whens = "".join(f" when {value} {op} {t} then {float(s)}" for t, s in table)
    first = f" when {value} is null then {'null' if missing is None else float(missing)}" if op != "<= 0" else ""
    return f"cast(case{first}{whens} else {float(beyond)} end as double)"


def tier(cap: str) -> str:
    return "case when {c} is null then 'Unknown' {w} else 'Unknown' end".format(c=cap, w=" ".join(f"when {cap} >= {lo:.0f}" + (f" and {cap} < {hi:.0f}" if hi else "") + f" then '{name}'" for name, lo, hi in CAP_TIERS))


def ctes(*parts: str) -> str:
    return "with " + ",\n".join(parts)


# ------------------------------------------------------------------ fixture views


def bars(q: Spark, name: str, ticker: str, extra: str = "", by: str = "1, 2") -> str:
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return f"""{name} as (select {ticker} as ticker{extra}, cast(l_shipdate as date) as date, {q.first_by('l_extendedprice', *keys)} as open, max(l_extendedprice) as high, min(l_extendedprice) as low,
  {q.last_by('l_extendedprice', *keys)} as close, sum(l_quantity) as volume
  from {q.t('lineitem')} join {q.t('supplier')} on l_suppkey = s_suppkey join {q.t('nation')} on s_nationkey = n_nationkey join {q.t('region')} on n_regionkey = r_regionkey group by {by})"""


def daily(q: Spark) -> str:
    return bars(q, "bars", "n_name", ", r_name as sector", "1, 2, 3")


def regional(q: Spark) -> str:
    return bars(q, "bars", "r_name")


def hourly(q: Spark) -> str:
    return f"bars as (select event_type as ticker, {q.hour('ts')} as date, {q.first_by('value', 'ts', 'event_id')} as open, max(value) as high, min(value) as low, {q.last_by('value', 'ts', 'event_id')} as close, sum(value) as volume from {q.t('events')} group by 1, 2)"


#: What an item alone tells of its trade.
PROFITS = "(l_discount - l_tax) * 100 as pnl_pct, l_extendedprice * (l_discount - l_tax) as pnl, round(l_discount * 100, 0) as signal_score"
REASON = "case l_returnflag || l_linestatus when 'AF' then 'stop_guard' when 'AO' then 'stop_breakeven' when 'NF' then 'stop_trail' when 'NO' then 'target_2' when 'RF' then 'score_deterioration' else 'delisted' end as exit_reason"


def trades(q: Spark) -> str:
    return f"""trades as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, n_name as ticker, r_name as sector, cast(least(o_orderdate, l_shipdate) as date) as entry_date, cast(greatest(o_orderdate, l_shipdate) as date) as exit_date,
  p_retailprice as entry_price, l_quantity as shares, {PROFITS},
  {REASON},
  case o_orderstatus when 'F' then 'bull' when 'O' then 'neutral' else 'bear' end as regime
  from {q.t('lineitem')} join {q.t('orders')} on l_orderkey = o_orderkey join {q.t('part')} on l_partkey = p_partkey join {q.t('supplier')} on l_suppkey = s_suppkey join {q.t('nation')} on s_nationkey = n_nationkey join {q.t('region')} on n_regionkey = r_regionkey)"""


def equity(q: Spark) -> str:
    return f"equity as (select {q.trunc('month', 'o_orderdate')} as date, sum(o_totalprice) as portfolio_value from {q.t('orders')} group by 1)"


def membership(q: Spark) -> str:
    o = f"(select o_custkey, cast(o_orderdate as date) as d, o_orderkey from {q.t('orders')})"
    return f"""gaps as (select *, case when {q.days('lag(d) over (partition by o_custkey order by d, o_orderkey)', 'd')} > 365 then 1 else 0 end as brk from {o} o),
islands as (select *, sum(brk) over (partition by o_custkey order by d, o_orderkey rows unbounded preceding) as k from gaps),
latest as (select max(d) as last_day from {o} o),
membership as (select o_custkey as ticker, min(d) as date_added, case when max(d) < {q.plus_days('max(last_day)', '-365')} then max(d) end as date_removed from islands cross join latest group by o_custkey, k)"""


def options(q: Spark) -> str:
    return f"""options_snapshot as (select user_id as ticker, 15 * count(*) filter (where event_type = 'click') as call_volume, 15 * count(*) filter (where event_type = 'error') as put_volume,
  cast(count(*) filter (where event_type = 'error') as double) / nullif(count(*) filter (where event_type = 'click'), 0) as pcr_volume, avg(value) / 20 as pcr_oi from {q.t('events')} group by 1)"""


# ------------------------------------------------------------------ indicators


def _ewm(x: str, decay: str) -> str:
    return f"sum({x} * power({decay}, -r)) over (partition by ticker, blk order by i rows unbounded preceding) * power({decay}, r)"


def _anchored(q: Spark, name: str, decay: str) -> str:
    return f"{name} + coalesce({q.carried(f'case when r = {BLOCK - 1} then {name} end', 'partition by ticker order by i rows between unbounded preceding and 1 preceding')}, 0) * power({decay}, r + 1)"


def indicators(q: Spark, source: str) -> list[str]:
    """bars -> ind: one causal pass gives the state of every ticker at every date."""
    w, rsi, atr = "over (partition by ticker order by date)", "cast(13 as double) / 14", "cast(13 as double) / 15"
    f = lambda n: f"over (partition by ticker order by i rows between {n - 1} preceding and current row)"
    full = lambda x, of, n: f"case when count({of}) {f(n)} = {n} then {x} end"
    return [
        source,
        f"b0 as (select *, cast(row_number() {w} - 1 as bigint) as i, close - lag(close) {w} as d, greatest(high - low, abs(high - lag(close) {w}), abs(low - lag(close) {w})) as tr from bars)",
        f"b1 as (select *, i % {BLOCK} as r, cast(floor(i / {BLOCK}) as bigint) as blk from b0)",
        f"b2 as (select *, {_ewm('greatest(d, 0)', rsi)} as g0, {_ewm('greatest(-d, 0)', rsi)} as l0, {_ewm('(case when i = 0 then 1.0 else 2.0 / 15 end) * tr', atr)} as a0 from b1)",
        f"b3 as (select *, {_anchored(q, 'g0', rsi)} as g, {_anchored(q, 'l0', rsi)} as l, {_anchored(q, 'a0', atr)} as a from b2)",
        f"""b4 as (select *, case when i < 14 or l = 0 then 50.0 else 100 - 100 / (1 + g / l) end as rsi, case when i >= 13 then a end as atr,
  {full(f'avg(close) {f(20)}', 'close', 20)} as sma, {full(f'stddev_samp(close) {f(20)}', 'close', 20)} as sd, {full(f'avg(volume) {f(20)}', 'volume', 20)} as avg_volume,
  (close - avg(close) {f(252)}) / nullif(stddev_samp(close) {f(252)}, 0) as z_score, {full(f'-100 * (max(high) {f(14)} - close) / nullif(max(high) {f(14)} - min(low) {f(14)}, 0)', 'close', 14)} as williams_r from b3)""",
        f"b5 as (select *, (close - (sma - 2 * sd)) / nullif(4 * sd, 0) as pct_b, {full(f'(rsi - min(rsi) {f(14)}) / nullif(max(rsi) {f(14)} - min(rsi) {f(14)}, 0)', 'rsi', 14)} as k0 from b4)",
        f"b6 as (select *, {full(f'avg(k0) {f(3)}', 'k0', 3)} as stoch_k from b5)",
        f"ind as (select *, {full(f'avg(stoch_k) {f(3)}', 'stoch_k', 3)} as stoch_d from b6)",
    ]


def scores(q: Spark, source: str) -> list[str]:
    """ind -> panel: sub-scores, the composite without options data, and the gates."""
    total = " + ".join(f"{n} * {w / (1 - WEIGHTS['s_pcr'])!r}" for n, w in WEIGHTS.items() if n != "s_pcr")
    return [
        *indicators(q, source),
        f"""sub as (select *, {steps('rsi', '<=', RSI_SCORES, 0)} as s_rsi, {steps('pct_b', '<', BOLLINGER_SCORES, 1, 5)} as s_bb, {steps('z_score', '<', ZSCORE_SCORES, 1, 5)} as s_mr,
  {steps('stoch_k', '<=', STOCHASTIC_SCORES, 0.5, 5)} as s_stochrsi, {steps('williams_r', '<=', WILLIAMS_SCORES, 0.5, 5)} as s_williams, count(*) over (partition by ticker) as n_bars from ind)""",
        f"panel as (select *, {total} as composite from sub)",
    ]


def r4(*names: str) -> str:
    return ", ".join(f"round({n}, 4) as {n}" for n in names)


LATEST = "last_bar as (select * from (select *, row_number() over (partition by ticker order by date desc) as back from panel) x where back = 1)"
GATE = "case when n_bars < 68 or close is null or close <= 0 then 'no_data' when avg_volume is null or avg_volume < 20 then 'volume' when rsi > 50 then 'rsi' when composite < 3 then 'low_score' else 'ok' end"


# ------------------------------------------------------------------ plans by name


def plans(q: Spark) -> dict[str, str]:
    ind, pan = ctes(*indicators(q, daily(q))), ctes(*scores(q, daily(q)), LATEST)
    panel = ctes(*scores(q, daily(q)))
    tr, eq = ctes(trades(q)), ctes(equity(q))
    reg = ctes(regional(q))
    out = {
        "bars_daily": f"{ctes(daily(q))} select * from bars",
        "bars_hourly": f"{ctes(hourly(q))} select * from bars",
        "rsi_wilder": f"{ind} select ticker, date, {r4('rsi')} from ind",
        "rsi_hourly": f"{ctes(*indicators(q, hourly(q)))} select ticker, date, {r4('rsi')} from ind",
        "bollinger_pctb": f"{ind} select ticker, date, {r4('sma', 'pct_b')} from ind",
        "atr_ema": f"{ind} select ticker, date, {r4('tr', 'atr')} from ind",
        "zscore_252": f"{ind} select ticker, date, {r4('z_score')} from ind",
        "stoch_rsi": f"{ind} select ticker, date, {r4('stoch_k', 'stoch_d')} from ind",
        "williams_r": f"{ind} select ticker, date, {r4('williams_r')} from ind",
        "volume_sma": f"{ind} select ticker, date, {r4('avg_volume')}, round(volume / nullif(avg_volume, 0), 4) as vol_ratio from ind",
        "subscores_case": f"{panel} select ticker, date, s_rsi, s_bb, s_mr, s_stochrsi, s_williams from panel where i >= 257",
        "composite_no_pcr": f"{panel} select ticker, date, round(composite, 4) as composite, case when composite >= 7.5 then 'Strong' when composite >= 6 then 'Watchlist' else 'Monitor' end as setup from panel where i >= 256",
        "score_history": f"{panel} select ticker, date, case when i < 257 then 'warmup' when rsi > 50 then 'rsi_too_high' when avg_volume is null or avg_volume < 20 then 'other' else 'ok' end as reason, case when i >= 257 and rsi <= 50 and avg_volume >= 20 then round(composite, 4) end as score from panel",
        "filter_summary": f"{pan} select {GATE} as reason, count(*) as n from last_bar group by 1",
        "sector_cap_topn": f"""{pan}, ok as (select * from last_bar where {GATE} = 'ok'), capped as (select *, row_number() over (partition by sector order by round(composite, 2) desc, ticker) as in_sector from ok)
select cast(row_number() over (order by round(composite, 2) desc, ticker) as bigint) as rank, ticker, sector, round(composite, 2) as composite, {r4('rsi', 'pct_b')} from capped where in_sector <= 3 order by 1 limit 10""",
        "trade_levels": f"{pan} select ticker, round(close - 1.5 * atr, 4) as stop_loss, round(close + 2 * atr, 4) as target_1, round(close + 4 * atr, 4) as target_2, round(close - 0.5 * atr, 4) as entry_low, round(close + 0.3 * atr, 4) as entry_high from last_bar where atr > 0",
        "cap_tiers": f"select c_custkey as ticker, {tier('c_acctbal * 1e8')} as cap_tier from {q.t('customer')}",
        "cap_tier_listing": f"with x as (select {tier('c_acctbal * 1e8')} as cap_tier, c_acctbal from {q.t('customer')}) select cap_tier, count(*) as n, max(c_acctbal) as largest from x group by 1",
        "pcr_score": f"""{ctes(options(q))}, g as (select *, {steps('pcr_volume', '>=', PCR_SCORES, 1)} as base from options_snapshot where coalesce(call_volume, 0) >= 200 and coalesce(call_volume, 0) + coalesce(put_volume, 0) >= 500)
select ticker, round(pcr_volume, 4) as pcr_volume, round(case when base >= 7 and pcr_oi >= 1.5 then least(base + 0.5, 10) when base >= 7 and pcr_oi < 0.5 then greatest(base - 0.5, 0) else base end, 1) as s_pcr from g""",
        "review_dates_monthly": f"{reg} select {q.trunc('month', 'date')} as month, min(date) as review_date from bars where date between {q.parse_date('1995-06-01')} and {q.parse_date('2000-12-31')} group by 1",
        "review_dates_weekly": f"{reg} select {q.trunc('week', 'date')} as week, min(date) as review_date from bars group by 1",
        "weekday_review_dates": f"""{reg}, days as (select distinct date from bars), wanted as (select distinct {q.plus_days(q.trunc('week', 'date'), '2')} as wanted from days), both_ as (select date as d, date as day from days union all select wanted, null from wanted),
ahead as (select d, day, {q.coming('day', 'order by d desc, case when day is null then 1 else 0 end rows between unbounded preceding and current row').replace('first_value', 'last_value')} as review_date from both_)
select distinct review_date from ahead where day is null and review_date is not null""",
        "membership_intervals": f"{ctes(membership(q))} select * from membership",
        "active_tickers": f"{ctes(membership(q))} select distinct ticker from membership where date_added <= {q.parse_date('1998-01-01')} and (date_removed is null or date_removed > {q.parse_date('1998-01-01')})",
        "asof_backward": f"""with x as (select user_id, ts, event_id, 1 as side, value, cast(null as double) as price from {q.t('events')} where event_type = 'purchase'
  union all select user_id, ts, event_id, 0, null, value from {q.t('events')} where event_type = 'view'),
y as (select *, {q.carried('price', 'partition by user_id order by ts, side, event_id rows between unbounded preceding and current row')} as last_price from x)
select event_id, user_id, value, last_price from y where side = 1""",
        "next_bar": f"{reg} select ticker, date, lead(date) over (partition by ticker order by date) as entry_date, lead(open) over (partition by ticker order by date) as entry_price from bars",
        "forward_returns": f"{reg} select ticker, date, " + ", ".join(f"round((lead(close, {5 * k}) over (partition by ticker order by date) / close - 1) * 100, 4) as ret_{k}w" for k in (1, 2, 3)) + " from bars",
        "trade_metrics": f"""{tr}, m as (select count(*) as n, count(*) filter (where pnl > 0) as wins, avg(pnl_pct) filter (where pnl > 0) as avg_win, avg(pnl_pct) filter (where pnl <= 0) as avg_loss, avg(pnl) as expectancy_abs from trades)
select n as n_trades, round(100.0 * wins / n, 2) as win_rate, round(avg_win, 2) as avg_win, round(avg_loss, 2) as avg_loss, round(coalesce(wins * avg_win / nullif(abs((n - wins) * avg_loss), 0), 0), 2) as profit_factor,
  round(cast(wins as double) / n * avg_win + (1 - cast(wins as double) / n) * avg_loss, 2) as expectancy_pct, round(expectancy_abs, 2) as expectancy_abs from m""",
        "equity_drawdown": f"{eq}, c as (select *, max(portfolio_value) over (order by date rows unbounded preceding) as peak from equity) select date, round(portfolio_value, 2) as portfolio_value, round((portfolio_value - peak) / peak * 100, 4) as drawdown from c",
        "sharpe_sortino_calmar": f"""{eq}, r as (select date, portfolio_value as v, portfolio_value / lag(portfolio_value) over (order by date) - 1 as ret, max(portfolio_value) over (order by date rows unbounded preceding) as peak from equity),
s as (select avg(ret) as mu, stddev_samp(ret) as sd, stddev_samp(ret) filter (where ret < 0) as down, min((v - peak) / peak) * 100 as dd, {q.days('min(date)', 'max(date)')} as n_days, {q.last_by('v', 'date')} / {q.first_by('v', 'date')} as growth from r)
select round(mu / nullif(sd, 0) * sqrt(12), 4) as sharpe, round(mu / nullif(down, 0) * sqrt(12), 4) as sortino, round(dd, 4) as max_drawdown, round((power(growth, 365.25 / n_days) - 1) * 100, 4) as annual_return, round((power(growth, 365.25 / n_days) - 1) * 100 / nullif(abs(dd), 0), 4) as calmar from s""",
        "reliability_grouping_sets": f"""{tr}, t as (select *, case when signal_score <= 0 or signal_score > 10 then null when signal_score <= 6 then '0-6' when signal_score <= 6.5 then '6-6.5' when signal_score <= 7 then '6.5-7' when signal_score <= 7.5 then '7-7.5' else '7.5-10' end as bucket from trades)
select case when grouping(regime) = 0 then 'regime' when grouping(bucket) = 0 then 'score' else 'exit' end as dimension, coalesce(regime, bucket, exit_reason) as value, count(*) as n_trades, round(100.0 * count(*) filter (where pnl_pct > 0) / count(*), 4) as win_rate, round(avg(pnl_pct), 4) as avg_pnl,
  round(avg({q.days('entry_date', 'exit_date')}), 4) as avg_hold from t group by grouping sets ((regime), (bucket), (exit_reason))""",
        "bucket_stats": f"{tr} select sector, count(*) as n, round(100.0 * count(*) filter (where pnl_pct > 0) / count(*), 4) as win_rate, round(avg(pnl_pct), 4) as mean, round(stddev_samp(pnl_pct), 4) as sd, round(avg(pnl_pct) / nullif(stddev_samp(pnl_pct), 0), 3) as trade_sharpe from trades group by 1",
        "crosstab_pivot": f"{tr} select exit_reason, count(*) filter (where regime = 'bull') as bull, count(*) filter (where regime = 'neutral') as neutral, count(*) filter (where regime = 'bear') as bear from trades group by 1",
        "concentration": f"{tr}, m as (select sector, {q.trunc('month', 'entry_date')} as month, count(*) as c from trades group by 1, 2) select sector, count(*) as months, max(c) as top_month, round(cast(max(c) as double) / sum(c), 4) as top_share from m group by 1",
        "describe_by_reason": f"{tr} select exit_reason, count(*) as n, round(avg(pnl_pct), 4) as mean, round(stddev_samp(pnl_pct), 4) as sd, round(min(pnl_pct), 4) as lowest, " + ", ".join(f"round({q.quantile('pnl_pct', p / 100)}, 4) as p{p}" for p in (25, 50, 75)) + ", round(max(pnl_pct), 4) as highest from trades group by 1",
        "entries_per_month": f"{tr} select {q.trunc('month', 'entry_date')} as month, count(*) as entries, count(distinct ticker) as tickers from trades group by 1",
        "missed_entries_anti": f"{tr} select distinct a.ticker, a.entry_date from trades a left join (select distinct ticker, entry_date from trades where regime = 'bull') b on a.ticker = b.ticker and a.entry_date = b.entry_date where a.regime = 'neutral' and b.ticker is null",
        "trade_overlap_jaccard": f"""{tr}, a as (select distinct ticker, entry_date from trades where regime = 'bull'), b as (select distinct ticker, entry_date from trades where regime = 'neutral')
select count(*) as either, count(a.ticker) filter (where b.ticker is not null) as both_sets, round(100.0 * count(a.ticker) filter (where b.ticker is not null) / count(*), 4) as jaccard from a full outer join b on a.ticker = b.ticker and a.entry_date = b.entry_date""",
        "dedup_trades": f"{tr} select ticker, entry_date, exit_date, round(pnl, 4) as pnl from (select *, row_number() over (partition by ticker, entry_date, exit_date order by l_orderkey, l_linenumber, l_partkey, l_suppkey, pnl) as k from trades) x where k = 1",
        "monthly_mode": f"{tr}, c as (select {q.trunc('month', 'entry_date')} as month, regime, count(*) as n from trades group by 1, 2) select month, regime from (select *, row_number() over (partition by month order by n desc, regime) as k from c) x where k = 1",
        "sector_rank": f"""{reg}, m as (select ticker, {q.trunc('month', 'date')} as month, {q.last_by('close', 'date')} as last_close from bars group by 1, 2), c as (select *, (last_close / lag(last_close, 3) over (partition by ticker order by month) - 1) * 100 as change from m)
select month, ticker, round(change, 4) as change, cast(rank() over (partition by month order by change desc) as bigint) as rank from c where change is not null""",
        "longest_streak": f"""{panel}, f as (select ticker, i, case when close < sma then 1 else 0 end as below from panel where sma is not null), g as (select *, i - sum(below) over (partition by ticker order by i rows unbounded preceding) as grp from f)
select ticker, max(n) as longest from (select ticker, grp, count(*) as n from g where below = 1 group by 1, 2) x group by 1""",
        "signal_events": f"{panel}, s as (select ticker, date, composite >= 7 as signal, lag(composite >= 7) over (partition by ticker order by date) as before from panel where i >= 257) select ticker, date from s where signal and not coalesce(before, false)",
        "distribution_by_date": f"{panel}, m as (select {q.trunc('month', 'date')} as month, composite from panel where i >= 257) select month, count(*) as n, round(avg(composite), 4) as mean, round(stddev_samp(composite), 4) as sd, round({q.skew('composite')}, 3) as skew, round(100.0 * count(*) filter (where composite >= 8.5) / count(*), 4) as high_pct, round({q.quantile('composite', 0.5)}, 4) as p50 from m group by 1 having count(*) > 3",
        "correlation_matrix": f"{panel} select " + ", ".join(f"round(corr({a}, {b}), 4) as {a}_{b}" for k, a in enumerate(("s_rsi", "s_bb", "s_mr", "s_stochrsi", "s_williams")) for b in ("s_rsi", "s_bb", "s_mr", "s_stochrsi", "s_williams")[k + 1 :]) + " from panel where i >= 257",
        "cluster_mean_test": f"""{tr}, m as (select avg(pnl_pct) as mu, count(*) as n from trades), g as (select {q.trunc('month', 'entry_date')} as c, sum(pnl_pct - mu) as u from trades cross join m group by 1)
select max(n) as n, count(*) as clusters, round(max(mu), 4) as mean, round(sqrt(count(*) / (count(*) - 1.0) * sum(u * u)) / max(n), 6) as se from g cross join m""",
        "ols_newey_west_hac": f"""{reg}, m as (select ticker, {q.trunc('month', 'date')} as month, {q.last_by('close', 'date')} as y0, {q.first_by('close', 'date')} as x0 from bars group by 1, 2),
r as (select ticker, month, ln(y0 / lag(y0) over (partition by ticker order by month)) as y, ln(x0 / lag(x0) over (partition by ticker order by month)) as x from m),
b as (select ticker, regr_slope(y, x) as beta, regr_intercept(y, x) as alpha, regr_r2(y, x) as r2, cast(count(*) as double) as n, sum(x) as sx, sum(x * x) as sxx, floor(4 * power(count(*) / 100.0, 2.0 / 9)) as lags from r where y is not null and x is not null group by 1 having count(*) > 2),
e as (select r.ticker, row_number() over (partition by r.ticker order by month) as t, lags, y - alpha - beta * x as u, (y - alpha - beta * x) * x as v from r join b on r.ticker = b.ticker where y is not null and x is not null),
g as (select p.ticker, (case when p.t = o.t then 0.5 else 1 - (p.t - o.t) / (p.lags + 1.0) end) as w, p.u as pu, p.v as pv, o.u as ou, o.v as ov from e p join e o on p.ticker = o.ticker and o.t <= p.t and p.t - o.t <= p.lags),
s as (select ticker, sum(2 * w * pu * ou) as s00, sum(w * (pu * ov + pv * ou)) as s01, sum(2 * w * pv * ov) as s11 from g group by 1),
z as (select b.*, s00, s01, s11, n * sxx - sx * sx as det from b join s on b.ticker = s.ticker)
select ticker, cast(n as bigint) as n, cast(lags as bigint) as lags, round(beta, 4) as beta, round(alpha, 4) as alpha, round(r2, 4) as r2, round(sqrt((sxx * sxx * s00 - 2 * sxx * sx * s01 + sx * sx * s11) / (det * det) * n / (n - 2)), 4) as se_alpha,
  round(sqrt((sx * sx * s00 - 2 * sx * n * s01 + n * n * s11) / (det * det) * n / (n - 2)), 4) as se_beta from z""",
        "autocorrelation": f"{eq}, r as (select date, portfolio_value / lag(portfolio_value) over (order by date) - 1 as ret from equity), l as (select ret, lag(ret) over (order by date) as before from r) select round(corr(ret, before), 4) as lag1, round(avg(ret), 6) as mean from l",
        "coverage_overall": f"""{ctes(membership(q), trades(q))}, seen as (select o_custkey as ticker, min(cast(o_orderdate as date)) as fv, max(cast(o_orderdate as date)) as lv from {q.t('orders')} where o_orderstatus <> 'P' group by 1),
c as (select m.ticker, greatest({q.days('date_added', "coalesce(date_removed, date '2001-12-31')")}, 0) as days, greatest({q.days('greatest(date_added, fv)', "least(coalesce(date_removed, date '2001-12-31'), lv)")}, 0) as covered from membership m left join seen s on m.ticker = s.ticker)
select count(*) as intervals, cast(sum(days) as bigint) as days, cast(sum(least(covered, days)) as bigint) as covered, round(100.0 * sum(least(covered, days)) / sum(days), 4) as pct from c""",
        "survivor_attribution": f"{tr}, s as (select ticker, max(exit_date) >= {q.parse_date('2000-06-01')} as survivor from trades group by 1) select survivor, count(*) as n, round(avg(pnl_pct), 4) as mean, round(variance(pnl_pct), 4) as var, round(100.0 * count(*) filter (where pnl_pct > 0) / count(*), 4) as win_rate from trades join s on trades.ticker = s.ticker group by 1",
        "sweep_pivot": f"{tr}, g as (select stop, target, avg(case when pnl_pct <= -stop then -stop when pnl_pct >= target then target else pnl_pct end) as metric from trades cross join (select 2.0 as stop union all select 4.0 union all select 6.0) a cross join (select 3.0 as target union all select 6.0 union all select 9.0) b group by 1, 2) select cast(stop as double) as stop, round(max(metric) filter (where target = 3), 4) as t3, round(max(metric) filter (where target = 6), 4) as t6, round(max(metric) filter (where target = 9), 4) as t9 from g group by 1",
        "cost_stress": f"{tr} select cast(mult as bigint) as mult, round(sum(pnl - 2 * mult * (shares * entry_price * 0.0005 + least(greatest(shares * 0.005 * mult, 1.0), shares * entry_price * 0.01))), 2) as net from trades cross join {q.series('k', '3')} cross join (select 1 as one) o join (select 1 as mult union all select 2 union all select 3) m on m.mult = k + 1 group by 1",
        "commission": f"{tr} select round(sum(least(greatest(abs(shares) * 0.005, 1.0), abs(shares) * entry_price * 0.01)), 4) as commission, count(*) as n from trades",
        "bs_call": f"""{tr}, x as (select distinct entry_price as s, 0.38 as v, 45.0 / 365 as t from trades), d as (select s, v, t, (ln(1.0) + (0.04 + v * v / 2) * t) / (v * sqrt(t)) as d1 from x), e as (select *, d1 - v * sqrt(t) as d2 from d),
f as (select s, t, """ + ", ".join(f"1 - exp(-{d} * {d} / 2) / sqrt(2 * pi()) * (0.319381530 * k{d} - 0.356563782 * power(k{d}, 2) + 1.781477937 * power(k{d}, 3) - 1.821255978 * power(k{d}, 4) + 1.330274429 * power(k{d}, 5)) as n{d}" for d in ("d1", "d2")) + """ from (select *, 1 / (1 + 0.2316419 * d1) as kd1, 1 / (1 + 0.2316419 * d2) as kd2 from e) y)
select round(s, 4) as strike, round(s * nd1 - s * exp(-0.04 * t) * nd2, 4) as premium from f""",
    }
    return out


