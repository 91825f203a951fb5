"""The operators applied to the fixture tables, each with SQL that was written by hand beside it.

The tables (bars, trades, membership, ...) are the fixture views of ``catalog``; what is
computed from them is not: queries call the DataFrame operators, the SQL says the same
in another engine's words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finance, tails
from ..functions import scores as S
from ..operators import backtest as B
from ..operators import choice as CH
from ..operators import coverage as C
from ..operators import diagnostics as D
from ..operators import exits as X
from ..operators import indicators as I
from ..operators import inference as V
from ..operators import lanes
from ..operators import ledger as L
from ..operators import metrics as M
from ..operators import monte_carlo, order, ranges
from ..operators import scan as SC
from ..operators import timeline as T
from ..operators.keep import kept
from . import catalog as K
from .run import _doubles, _Oracle, _Views, outcomes, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "1998-12-01"


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = _doubles(oracle)
        return f

    return put


class Tables:
    """The fixture views of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.q = spark, sf_dir, _Views()
        self._bars: dict[str, DataFrame] = {}

    def get(self, *ctes: str, table: str, columns: str = "*") -> DataFrame:
        return sql(_doubles(f"{K.ctes(*ctes)} select {columns} from {table}"), self.spark, self.dir)

    def bars(self, name: str, cte: str, *extra: str) -> DataFrame:
        """A row for each ticker and day, whatever the number of items: made once from all of them."""
        if name not in self._bars:
            self._bars[name] = kept(self.get(cte, table="bars", columns=", ".join(["ticker", *extra, "date", "open", "high", "low", "close", "cast(volume as double) as volume"])), name)
        return self._bars[name]

    def daily(self) -> DataFrame:
        return self.bars("daily", K.daily(self.q), "sector").drop("sector")

    def region(self) -> DataFrame:
        return self.bars("region", K.regional(self.q))

    def trades(self) -> DataFrame:
        return self.get(K.trades(self.q), table="trades").withColumn("exit_price", F.col("entry_price") * (1 + F.col("pnl_pct") / 100))

    def equity(self) -> DataFrame:
        return self.get(K.equity(self.q), table="equity")

    def membership(self) -> DataFrame:
        return sql(_doubles(f"with {K.membership(self.q)} select * from membership"), self.spark, self.dir)

    def caps(self) -> DataFrame:
        return sql(f"select * from ({CAPS.format(n='ledgerline_nation', r='ledgerline_region')}) x", self.spark, self.dir)

    def options(self) -> DataFrame:
        return sql(f"select * from ({OPTIONS.format(n='ledgerline_nation')}) x", self.spark, self.dir)

    def earnings(self) -> DataFrame:
        return sql(f"select * from ({EARNINGS.format(n='ledgerline_nation', add='date_add(')}) x", self.spark, self.dir)

    def components(self) -> DataFrame:
        return sql(_doubles(f"with {COMPONENTS.format(o='ledgerline_orders')} select * from components"), self.spark, self.dir)

    def held(self) -> DataFrame:
        """Few rows of the trades, made once."""
        return kept(sql(_doubles(f"with {K.trades(self.q)}, {POSITIONS} select * from positions"), self.spark, self.dir), "positions")

    def seen(self) -> DataFrame:
        """Bars of customers: what membership is covered by."""
        return sql("select o_custkey as ticker, cast(o_orderdate as date) as date, o_totalprice as close from ledgerline_orders where o_orderstatus <> 'P'", self.spark, self.dir)


CAPS = "select n_name as ticker, case when n_nationkey % 6 = 4 then null else r_name end as sector, case when n_nationkey % 7 = 3 then null else cast(n_nationkey * 41 % 25 as double) * 3e10 end as market_cap from {n} join {r} on n_regionkey = r_regionkey where n_nationkey % 11 <> 5"
OPTIONS = "select n_name as ticker, case when n_nationkey % 9 = 8 then 'failed' end as error, 40 * n_nationkey as call_volume, 13 * (n_nationkey * 17 % 40) * 3 as put_volume, cast(13 * (n_nationkey * 17 % 40) * 3 as double) / nullif(40 * n_nationkey, 0) as pcr_volume, cast(n_nationkey % 5 as double) / 2 as pcr_oi from {n}"
EARNINGS = "select n_name as ticker, date '1998-11-20' + cast(n_nationkey as int) as earnings_date from {n}"
COMPONENTS = """totals as (select cast(o_orderdate as date) as date, sum(o_totalprice) as total from {o} group by 1),
moving as (select date, total, avg(total) over (order by date rows between 19 preceding and current row) as mean, row_number() over (order by date) as n from totals),
components as (select date, case when total > 1.2 * mean then 'bull' when total < 0.8 * mean then 'bear' else 'neutral' end as regime,
  case when n % 13 = 0 then null when total > 1.1 * mean then 'bull' when total < 0.7 * mean then 'bear' else 'neutral' end as dispersion_signal, total / mean as dispersion from moving)"""
#: A ledger: each ticker's first trades by key; every third is closed.
POSITIONS = """numbered as (select *, row_number() over (partition by ticker order by entry_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, pnl) as k from trades where entry_date >= date '1996-01-01'),
positions as (select ticker, sector, entry_date, entry_price, shares, case when k % 3 = 0 then 'closed' else 'open' end as status, case when k % 3 = 0 then exit_date end as exit_date, case when k % 3 = 0 then entry_price * (1 + pnl_pct / 100) end as exit_price,
  cast(1000 * k as double) as stop_loss, cast(20000 * k as double) as target from numbered where k <= 4)"""

q = _Oracle()
DAILY, REGION, TRADES, EQUITY = K.daily(q), K.regional(q), K.trades(q), K.equity(q)
MEMBERSHIP = K.membership(q)
O_CAPS, O_OPTIONS, O_EARNINGS = f"caps as ({CAPS.format(n='nation', r='region')})", f"options as ({OPTIONS.format(n='nation')})", f"earnings as ({EARNINGS.format(n='nation')})"
O_COMPONENTS = COMPONENTS.format(o="orders")
PANEL = ",\n".join(K.scores(q, DAILY))
R_PANEL = ",\n".join(K.scores(q, REGION))


def r(n: int, *names: str) -> str:
    return ", ".join(f"round({x}, {n}) as {x}" for x in names)


# ------------------------------------------------------------------ sources


@query(f"with {DAILY} select ticker, arg_max(close, date) as price, max(date) as date from bars group by 1")
def latest_close(spark, d):
    return T.latest(Tables(spark, d).daily())


@query(f"with {REGION} select date, open, close from bars where ticker = 'ASIA' and date between date '1996-03-01' and date '1996-09-30'")
def benchmark_range(spark, d):
    return T.clip(Tables(spark, d).region().where("ticker = 'ASIA'"), "1996-03-01", "1996-09-30").select("date", "open", "close")


@query(f"with {DAILY}, {O_EARNINGS} select distinct b.ticker from bars b join earnings e on b.ticker = e.ticker where abs(date_diff('day', date '{AS_OF}', earnings_date)) <= 7")
def earnings_near(spark, d):
    t = Tables(spark, d)
    return SC.near_earnings(t.daily().select("ticker").distinct(), t.earnings(), F.lit(AS_OF).cast("date"))


@query(f"""with {TRADES}, {O_COMPONENTS}, e as (select distinct entry_date as d from trades), u as (select d, null as regime, null as s, 1 as side from e union all select date, regime, dispersion_signal, 0 from components),
f as (select d, side, last_value(regime ignore nulls) over (order by d, side) as regime_at, last_value(s ignore nulls) over (order by d, side) as s from u), g as (select d, regime_at, s from f where side = 1)
select coalesce(regime_at, 'none') as regime_at, case s when 'bull' then 'broad' when 'neutral' then 'neutral' when 'bear' then 'narrow' else 'n/a' end as bucket, case when s = 'bull' then 'broad' when s in ('neutral', 'bear') then 'not_broad' else 'unknown' end as two,
  count(*) as n, round(avg(pnl_pct), 4) as avg_pnl from trades join g on entry_date = d group by 1, 2, 3""")
def regime_asof(spark, d):
    t = Tables(spark, d)
    c = t.components()
    x = T.asof(t.trades(), c.select(F.col("date").alias("entry_date"), F.col("regime").alias("regime_at")), [], "entry_date", ["regime_at"])
    x = T.asof(x, c.where("dispersion_signal is not null").select(F.col("date").alias("entry_date"), F.col("dispersion_signal").alias("signal_at")), [], "entry_date", ["signal_at"])
    s = F.col("signal_at")
    return x.groupBy(F.coalesce("regime_at", F.lit("none")).alias("regime_at"), S.dispersion_bucket(s).alias("bucket"), S.two_bucket(s).alias("two")).agg(F.count("*").alias("n"), F.round(F.avg("pnl_pct"), 4).alias("avg_pnl"))


# ------------------------------------------------------------------ the scan

_SCAN = f"""with {PANEL}, {O_CAPS}, {O_OPTIONS}, {O_EARNINGS},
pct as (select ticker, date, case when atr is not null then 100.0 * count(o) / any_value(n) end as atr_percentile from (select a.ticker, a.date, a.atr, a.n, b.atr as o from (select ticker, date, i, atr, count(atr) over (partition by ticker order by i rows between 251 preceding and current row) as n from panel) a
  left join panel b on b.ticker = a.ticker and b.i between a.i - 251 and a.i and b.atr <= a.atr where a.i = (select max(i) from panel m where m.ticker = a.ticker)) x group by ticker, date, atr),
lb as (select panel.*, p.atr_percentile from panel join pct p on p.ticker = panel.ticker and p.date = panel.date),
op as (select ticker, pcr_volume, case when pcr_volume is null then null when pcr_volume >= 3 then 10.0 when pcr_volume >= 2 then 9.0 when pcr_volume >= 1.5 then 8.0 when pcr_volume >= 1.2 then 7.0 when pcr_volume >= 1 then 6.0 when pcr_volume >= 0.7 then 4.0 when pcr_volume >= 0.5 then 2.5 else 1.0 end as base, pcr_oi from options where error is null and call_volume >= 200 and call_volume + put_volume >= 500),
j as (select lb.* exclude (sector, composite), coalesce(c.sector, 'Unknown') as sector, c.market_cap, op.pcr_volume, round(case when base >= 7 and pcr_oi >= 1.5 then least(base + 0.5, 10) when base >= 7 and pcr_oi < 0.5 then greatest(base - 0.5, 0) else base end, 1) as s_pcr,
  earnings_date is not null as near from lb left join caps c on c.ticker = lb.ticker left join op on op.ticker = lb.ticker left join (select * from earnings where abs(date_diff('day', date '{AS_OF}', earnings_date)) <= 2) e on e.ticker = lb.ticker),
k as (select *, round(case when s_pcr is not null then 0.3 * s_rsi + 0.2 * s_bb + 0.15 * s_mr + 0.15 * s_pcr + 0.1 * s_stochrsi + 0.1 * s_williams else (0.3 * s_rsi + 0.2 * s_bb + 0.15 * s_mr + 0.1 * s_stochrsi + 0.1 * s_williams) / 0.85 end, 2) as composite from j),
scanned as (select *, case when n_bars < 68 or close <= 0 then 'no_data' when avg_volume is null or avg_volume < 20 then 'volume' when market_cap is null or not (market_cap >= 5e10) then 'market_cap' when rsi > 50 then 'rsi' when near then 'earnings' when composite < 3 then 'low_score' else 'ok' end as reason,
  round(close - 1.5 * atr, 2) as stop_loss, round(close + 2 * atr, 2) as target_1, round(close + 4 * atr, 2) as target_2, round(close - 0.5 * atr, 2) as entry_low, round(close + 0.3 * atr, 2) as entry_high from k)"""
_LARGE = ("Large", "Very Large", "Mega")


def _scanned(spark, d, tiers=_LARGE, **how) -> DataFrame:
    t = Tables(spark, d)
    e = t.earnings().where(F.abs(F.datediff("earnings_date", F.lit(AS_OF).cast("date"))) <= 2)
    return SC.scan(t.daily(), t.caps(), t.options(), e, AS_OF, tiers=tiers, min_avg_volume=20.0, min_score=3.0, **how)


@query(f"""{_SCAN} select ticker, sector, market_cap, reason, round(composite, 2) as composite, case when composite >= 7.5 then 'Strong' when composite >= 6 then 'Watchlist' else 'Monitor' end as setup, s_pcr, {r(4, 'rsi', 'pct_b', 'z_score', 'atr', 'atr_percentile', 'pcr_volume')},
  case when atr_percentile < 25 then 'compression' when atr_percentile > 75 then 'expansion' when atr_percentile is not null then 'normal' end as atr_regime, round(case when avg_volume > 0 then volume / avg_volume else 1 end, 4) as vol_ratio,
  stop_loss, target_1, target_2, entry_low, entry_high, case when close - stop_loss > 0 then round((target_2 - close) / (close - stop_loss), 2) end as rr_ratio,
  case when s_pcr is not null then 'RSI=0.3 BB=0.2 MR=0.15 PCR=0.15 StochRSI=0.1 Williams=0.1' else 'RSI=0.353 BB=0.235 MR=0.176 StochRSI=0.118 Williams=0.118 (no PCR)' end as weights_used from scanned""")
def live_scan(spark, d):
    x = _scanned(spark, d)
    four = [F.round(c, 4).alias(c) for c in ("rsi", "pct_b", "z_score", "atr", "atr_percentile", "pcr_volume", "vol_ratio")]
    return x.select("ticker", "sector", "market_cap", "reason", "composite", "setup", "s_pcr", *four, "atr_regime", "stop_loss", "target_1", "target_2", "entry_low", "entry_high", "rr_ratio", "weights_used")


@query(f"{_SCAN} select reason, count(*) as n from scanned group by 1")
def scan_reasons(spark, d):
    return SC.filter_summary(_scanned(spark, d))


_ANY = _SCAN.replace("when market_cap is null or not (market_cap >= 5e10) then 'market_cap' ", "")


@query(f"""{_ANY}, c as (select *, row_number() over (partition by sector order by composite desc, ticker) as k from scanned where reason = 'ok')
select row_number() over (order by composite desc, ticker) as rank, ticker, sector, composite from c where k <= 2 order by 1 limit 8""")
def scan_ranking(spark, d):
    return SC.ranked(_scanned(spark, d, ()), 8, 2).select("rank", "ticker", "sector", "composite")


@query(f"""{_ANY}, c as (select *, row_number() over (partition by sector order by composite desc, ticker) as k from scanned where reason = 'ok'),
t as (select row_number() over (order by composite desc, ticker) as rank, * from c where k <= 2 order by 1 limit 8)
select rank as "Rank", ticker as "Ticker", sector as "Sector", {K.tier('market_cap')} as "Cap", composite as "Score", round(rsi, 1) as "RSI", s_rsi as "s_RSI", round(z_score, 2) as "Z_Score", round(close, 2) as "Price", stop_loss as "Stop", target_2 as "T2" from t""")
def scan_display(spark, d):
    return SC.display(SC.ranked(_scanned(spark, d, ()), 8, 2)).select("Rank", "Ticker", "Sector", "Cap", "Score", "RSI", "s_RSI", "Z_Score", "Price", "Stop", "T2")


_WATCHED = ("NATION_1", "NATION_7", "NATION_12", "NATION_21", "NOWHERE")


@query(f"""with {PANEL} select ticker, round((0.3 * s_rsi + 0.2 * s_bb + 0.15 * s_mr + 0.1 * s_stochrsi + 0.1 * s_williams) / 0.85, 2) as composite, round(rsi, 4) as rsi from panel
where ticker in {_WATCHED} and n_bars >= 68 and date = (select max(date) from panel m where m.ticker = panel.ticker)""")
def watchlist_scan(spark, d):
    return SC.watchlist(Tables(spark, d).daily(), _WATCHED).select("ticker", "composite", F.round("rsi", 4).alias("rsi"))


@query("select 'NOWHERE' as ticker, 'no data' as reason union all select n_name, 'no data' from nation where n_name in ('NATION_1', 'NATION_7', 'NATION_12', 'NATION_21') and n_nationkey not in (select s_nationkey from supplier join lineitem on l_suppkey = s_suppkey)")
def watchlist_excluded(spark, d):
    bars = Tables(spark, d).daily()
    wanted = spark.createDataFrame([(t,) for t in _WATCHED], "ticker string")
    return SC.excluded(bars, wanted, SC.watchlist(bars, _WATCHED))


@query(f"""{_ANY}, a as (select 'alerts' as section, ticker, composite from scanned where reason = 'ok' and composite >= 4) select section, ticker, 'Score: ' || format('{{:.1f}}', round(composite, 1)) as score from a""")
def alerts_above(spark, d):
    x = SC.alerts(_scanned(spark, d, ()), 4.0)
    return SC.digest(x, x.limit(0), spark.createDataFrame([], "ticker string, reason string")).select("section", "ticker", F.regexp_extract("line", r"^(Score: \S+)", 1).alias("score"))


@query(f"""with {R_PANEL}, n as (select ticker, date, i, atr, count(atr) over (partition by ticker order by i rows between 251 preceding and current row) as n from panel)
select a.ticker, a.date, round(100.0 * count(b.atr) / any_value(a.n), 4) as atr_percentile from n a join n b on b.ticker = a.ticker and b.i between a.i - 251 and a.i and b.atr <= a.atr where a.date >= date '1998-06-01' and a.atr is not null group by 1, 2""")
def atr_percentiles(spark, d):
    return I.indicators(Tables(spark, d).region(), True).where("date >= date '1998-06-01' and atr is not null").select("ticker", "date", F.round("atr_percentile", 4).alias("atr_percentile"))


@query(f"with {PANEL} select ticker, {r(4, 'rsi', 'z_score', 'atr')} from panel where date = (select max(date) from panel m where m.ticker = panel.ticker)")
def lookback_capped(spark, d):
    x = I.indicators(I.lookback(Tables(spark, d).daily(), 320))
    return x.groupBy("ticker").agg(*[F.round(F.max_by(c, "date"), 4).alias(c) for c in ("rsi", "z_score", "atr")])


@query(f"""with {PANEL} select ticker, date, round(close, 4) as price, round(rsi, 4) as rsi, case when i < 257 then 'warmup' when rsi > 50 then 'rsi_too_high' when avg_volume >= 20 and atr > 0 then 'ok' else 'other' end as reason,
  case when i >= 257 and rsi <= 50 and avg_volume >= 20 and atr > 0 then round(composite, 4) end as score from panel""")
def score_histories(spark, d):
    x = SC.score_history(Tables(spark, d).daily(), min_avg_volume=20.0)
    return x.select("ticker", "date", F.round("price", 4).alias("price"), F.round("rsi", 4).alias("rsi"), "reason", F.round("score", 4).alias("score"))


_EVENTS = f"""with {PANEL}, h as (select ticker, date, i, close as price, case when i >= 257 and rsi <= 50 and avg_volume >= 20 and atr > 0 then composite end as score from panel),
e as (select *, price = min(price) over (partition by ticker order by i rows between 10 preceding and 10 following) as is_min, price = max(price) over (partition by ticker order by i rows between 10 preceding and 10 following) as is_max, coalesce(score >= 6.5, false) as s from h),
f as (select *, max(case when is_min then 1 else 0 end) over (partition by ticker order by i rows between 5 preceding and 5 following) = 1 as hit_bottom, coalesce(lag(s) over (partition by ticker order by i), false) as b, lead(price, 5) over (partition by ticker order by i) as p1, lead(price, 15) over (partition by ticker order by i) as p3,
  first_value(case when is_min or is_max then price end ignore nulls) over (partition by ticker order by i rows between 1 following and unbounded following) as nx, first_value(case when is_min then 'min' when is_max then 'max' end ignore nulls) over (partition by ticker order by i rows between 1 following and unbounded following) as nk from e)"""


@query(f"{_EVENTS} select ticker, date, round(score, 4) as score, hit_bottom, round((p1 - price) / price * 100, 1) as ret_1w, round((p3 - price) / price * 100, 1) as ret_3w, round((nx - price) / price * 100, 1) as next_move, nk as next_kind from f where s and not b")
def signal_summary(spark, d):
    x = I.signal_events(SC.score_history(Tables(spark, d).daily(), min_avg_volume=20.0))
    return x.select("ticker", "date", F.round("score", 4).alias("score"), "hit_bottom", "ret_1w", "ret_3w", "next_move", "next_kind")


@query(f"{_EVENTS} select count(*) as n, round(100.0 * count(*) filter (where hit_bottom) / count(*), 4) as hit_rate, round(avg(round((p1 - price) / price * 100, 1)), 4) as mean_1w from f where s and not b")
def signal_hit_rate(spark, d):
    x = I.signal_events(SC.score_history(Tables(spark, d).daily(), min_avg_volume=20.0))
    return x.agg(F.count("*").alias("n"), F.round(F.count_if("hit_bottom") / F.count("*") * 100, 4).alias("hit_rate"), F.round(F.avg("ret_1w"), 4).alias("mean_1w"))


@query(f"with {REGION} select ticker, date, close = min(close) over w as is_min, close = max(close) over w as is_max from bars window w as (partition by ticker order by date rows between 10 preceding and 10 following)")
def extrema_flags(spark, d):
    return I.extrema(Tables(spark, d).region(), price="close").select("ticker", "date", "is_min", "is_max")


@query(f"""with {O_COMPONENTS}, f as (select date, row_number() over (order by date) as n, dispersion_signal = 'bear' as x from components where dispersion_signal is not null), g as (select n - row_number() over (order by n) as run from f where x)
select 'all' as k, max(c) as longest from (select count(*) as c from g group by run)""")
def longest_narrow_run(spark, d):
    c = Tables(spark, d).components().where("dispersion_signal is not null").withColumn("k", F.lit("all"))
    x = I.longest_run(c, "k", "date", F.col("dispersion_signal") == "bear")
    return x.agg(F.lit("all").alias("k"), F.max("longest").alias("longest"))  # a row, null, if there is no such day


@query(f"""with {PANEL}, {O_COMPONENTS}, days as (select distinct date from bars), tue as (select cast(x as date) as want from (select unnest(generate_series((select min(date) from days), (select max(date) from days), interval 1 day)) as x) where isodow(x) = 2),
rev as (select distinct (select min(date) from days where date >= want) as rd from tue where want <= (select max(date) from days)), seen_at as (select ticker, rd, max(date) as bar from rev join panel on panel.date <= rd group by 1, 2)
select a.ticker, rd as date, round(close, 2) as price, s_rsi, s_bb, s_mr, s_stochrsi, s_williams from seen_at a join panel p on p.ticker = a.ticker and p.date = a.bar where i >= 256 and close > 0 and avg_volume >= 20 and rsi <= 50 and atr > 0 and pct_b is not null and stoch_k is not null and williams_r is not null""")
def score_panels(spark, d):
    return D.score_panel(Tables(spark, d).daily(), min_avg_volume=20.0).select("ticker", "date", "price", *D.SUBSCORES)


_SNAP = f"""with {PANEL}, m as (select cast(date_trunc('month', date) as date) as mo, min(date) as rd from bars group by 1), seen_at as (select ticker, rd, max(date) as bar from m join panel on panel.date <= rd group by 1, 2),
snap as (select a.ticker, rd as date, s_rsi, s_bb, s_mr, s_stochrsi, s_williams, (0.3 * s_rsi + 0.2 * s_bb + 0.15 * s_mr + 0.1 * s_stochrsi + 0.1 * s_williams) / 0.85 as c from seen_at a join panel p on p.ticker = a.ticker and p.date = a.bar
  where i >= 256 and close > 0 and avg_volume >= 20 and rsi <= 50 and atr > 0 and pct_b is not null and stoch_k is not null and williams_r is not null)"""


def _snapshots(spark, d) -> DataFrame:
    return D.score_panel(Tables(spark, d).daily(), None, min_avg_volume=20.0)


@query(f"""{_SNAP} select date, count(*) as n, round(avg(c), 2) as mean, round(stddev_samp(c), 2) as std, case when count(*) > 2 then round(skewness(c), 2) end as skew, round(100.0 * count(*) filter (where c >= 8.5) / count(*), 1) as pct_top_bin, round(100.0 * count(*) filter (where c <= 2) / count(*), 1) as pct_bottom_bin,
  round(quantile_cont(c, 0.1), 2) as p10, round(quantile_cont(c, 0.5), 2) as p50, round(quantile_cont(c, 0.9), 2) as p90 from snap group by 1""")
def score_distribution(spark, d):
    x = D.distribution(_snapshots(spark, d))
    return x.withColumn("skew", F.when(~F.isnan("skew"), F.col("skew")))


@query(f"{_SNAP}, l as (select date, round(100.0 * count(*) filter (where c >= 8.5) / count(*), 1) as p from snap group by 1) select round(avg(p), 4) as avg_pct_top_bin, case when avg(p) >= 15 then 'saturated' when avg(p) >= 8 then 'borderline' else 'ok' end as verdict from l")
def score_saturation(spark, d):
    return D.saturation_verdict(D.distribution(_snapshots(spark, d)))


_PAIRS = [(a, b) for k, a in enumerate(D.SUBSCORES) for b in D.SUBSCORES[k + 1 :]]


@query(f"{_SNAP} " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 4) as corr, abs(corr({a}, {b})) >= 0.6 as flagged from snap" for a, b in _PAIRS))
def subscore_correlations(spark, d):
    return D.correlation_audit(_snapshots(spark, d))


_RANKED = ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as r_{c}" for c in D.SUBSCORES)


@query(f"{_SNAP}, k as (select {_RANKED} from snap) " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr(r_{a}, r_{b}), 4) as corr, abs(corr(r_{a}, r_{b})) >= 0.6 as flagged from k" for a, b in _PAIRS))
def subscore_rank_correlations(spark, d):
    return D.correlation_audit(_snapshots(spark, d), "spearman")


@query()
def weight_sensitivity(spark, d):
    return D.sensitivity_summary(D.weight_sensitivity(_snapshots(spark, d)))


# ------------------------------------------------------------------ scalar functions


@query(f"""with {TRADES} select strftime(entry_date, '%Y') || 'Q' || quarter(entry_date) as quarter, strftime(entry_date, '%Y-%m') as month, format('{{}}-W{{:02d}}', isoyear(entry_date), weekofyear(entry_date)) as week, count(*) as n from trades group by 1, 2, 3""")
def date_keys(spark, d):
    c = F.col("entry_date")
    return Tables(spark, d).trades().groupBy(S.period_key(c, "quarter").alias("quarter"), S.period_key(c, "month").alias("month"), S.period_key(c, "week").alias("week")).agg(F.count("*").alias("n"))


@query("""with p as (select n_nationkey as i, '{"hold":' || (10 + n_nationkey) || ',"label":"run ' || n_name || '","top":' || n_regionkey || '}' as js from nation) select i, substr(sha256(js), 1, 10) as params_hash, js from p""")
def params_hashes(spark, d):
    x = sql("select n_nationkey as i, n_regionkey as top, n_nationkey + 10 as hold, concat('run ', n_name) as label from ledgerline_nation", spark, d)
    parsed = x.withColumn("js", F.to_json(F.struct("hold", "label", "top")))
    back = F.from_json("js", "hold long, label string, top long")
    return parsed.where((back["top"] == F.col("top")) & (back["label"] == F.col("label"))).select("i", S.params_hash("hold", "label", "top").alias("params_hash"), "js")


@query(f"{_SNAP} select date, count(*) as n, round(avg(0.4 * s_rsi + 0.2182 * s_bb + 0.1636 * s_mr + 0.1091 * s_stochrsi + 0.1091 * s_williams), 8) as mean from snap group by 1")
def reweighted_scores(spark, d):
    """One weight is set, the others scale; the snapshots are scored by the new weights."""
    own = S.adjust_weight({k: w for k, w in S.V.WEIGHTS.items() if k != "s_pcr"}, "s_rsi", 0.4)
    return _snapshots(spark, d).groupBy("date").agg(F.count("*").alias("n"), F.round(F.avg(sum((w * F.col(k) for k, w in own.items()), F.lit(0.0))), 8).alias("mean"))


@query(f"""with {TRADES}, c as (select sum(ln(1 + pnl_pct / 500)) over (order by entry_date, l_orderkey, l_linenumber rows unbounded preceding) as level, row_number() over (order by entry_date, l_orderkey, l_linenumber) as k from trades),
p as (select k, level, greatest(max(level) over (order by k rows unbounded preceding), 0) as peak from c) select count(*) as n_draws, round(arg_max(level, k), 6) as log_growth, round((exp(min(level - peak)) - 1) * 100, 6) as max_drawdown from p""")
def trade_path(spark, d):
    """The trades compounded in the order that happened: what simulated orders are held against."""
    x = monte_carlo.happened(Tables(spark, d).trades(), "entry_date", ["l_orderkey", "l_linenumber"])
    return x.select("n_draws", F.round("log_growth", 6).alias("log_growth"), F.round("max_drawdown", 6).alias("max_drawdown"))


@query()
def monte_carlo_bands(spark, d):
    """Bootstrapped and shuffled paths of all trades: bands, the chance of a loss, the ranks of what happened."""
    t = Tables(spark, d).trades()
    known = kept(monte_carlo.happened(t, "entry_date", ["l_orderkey", "l_linenumber"]), "known")
    values = monte_carlo.tally(t)
    of = lambda m: monte_carlo.bands(monte_carlo.simulate(t, method=m, values=values), known).withColumn("method", F.lit(m))
    return of("bootstrap").unionByName(of("shuffle")).withColumn("verdict", F.when(F.col("method") == "bootstrap", D.luck_verdict(F.col("known_return_percentile"))))


_Z = "(1.959963984540054 + 0.8416212335729143)"


@query(f"""with {TRADES}, m as (select count(*) as n, avg(pnl_pct) as mu, stddev_samp(pnl_pct) as sd, date_diff('day', min(entry_date), max(entry_date)) / 365.25 as years from trades), g as (select date_trunc('month', entry_date) as c, sum(pnl_pct) - any_value(mu) * count(*) as u from trades, m group by 1), s as (select count(*) as k, sum(u * u) as uu from g),
z as (select n, mu, sd, years, n / ((k / (k - 1.0) * uu / n / n) / (sd * sd / n)) as ne from m, s) select n as n_raw, round(ne, 2) as n_eff, round(pow({_Z} * sd / mu, 2), 2) as required_n_eff, round(ne / pow({_Z} * sd / mu, 2), 4) as adequacy_ratio, round({_Z} * sd / sqrt(ne), 4) as mde_mean_pct, round(ne / years, 2) as effective_trades_per_year, round(pow({_Z} * sd / mu, 2) / (ne / years), 4) as years_needed from z where mu > 0""")
def trade_sample_size(spark, d):
    """How many independent trades would show the edge of the trades that there are."""
    t = Tables(spark, d).trades()
    c, span = V.cluster_test(t, digits=None).first(), t.agg((F.datediff(F.max("entry_date"), F.min("entry_date")) / 365.25).alias("years")).first()
    x = V.sample_size(c["mean"], c["sd"], c["n"], c["n_eff"], span["years"])
    digits = {"n_eff": 2, "required_n_eff": 2, "adequacy_ratio": 4, "mde_mean_pct": 4, "effective_trades_per_year": 2, "years_needed": 4}
    return spark.createDataFrame([tuple(x.values())], ", ".join(f"{k} {'long' if k == 'n_raw' else 'double'}" for k in x)).where(F.lit(c["mean"] > 0)).select("n_raw", *[F.round(k, n).alias(k) for k, n in digits.items()])


@query(f"""with {TRADES}, e as (select min(entry_date) as a, max(entry_date) as z from trades), w as (select count(*) as n from (select unnest(range(400)) as k) x, e where cast(a + to_months(cast(6 * k as integer)) as date) + interval 24 month <= z)
select cast(n as bigint) as n_windows, cast(floor(date_diff('day', a, z) / 365.25 / 2) as bigint) as n_independent, round(date_diff('day', a, z) / 365.25, 4) as total_years, 75.0 as overlap_pct, 4.0 as windows_per_event from w, e""")
def window_overlap(spark, d):
    """Rolling windows over the dates of the trades, and how many of them do not overlap."""
    a, z = Tables(spark, d).trades().agg(F.min("entry_date"), F.max("entry_date")).first()
    w = V.window_independence(str(a), str(z))
    row = (w["n_windows"], w["n_independent"], round(w["total_years"], 4), w["overlap_pct"], w["windows_per_event"])
    return spark.createDataFrame([row], "n_windows long, n_independent long, total_years double, overlap_pct double, windows_per_event double")


@query(f"""with {EQUITY}, r as (select date, portfolio_value / lag(portfolio_value) over (order by date) - 1 as y from equity), m as (select avg(y) as a, stddev_samp(y) as sd from r) select round(a, 6) as mean, case when a > 0 then round(pow({_Z} * sd / a, 2), 1) else 'inf'::double end as months from m""")
def months_needed(spark, d):
    """How many months would show the mean monthly return of the curve."""
    a, sd = I.period_returns(Tables(spark, d).equity()).agg(F.avg("ret"), F.stddev_samp("ret")).first()
    months = tails.required_periods(a, sd)
    return spark.createDataFrame([(round(a, 6), round(months, 1) if months < float("inf") else months)], "mean double, months double")


def _phi(x: str) -> str:
    k = f"(1 / (1 + 0.2316419 * abs({x})))"
    t = f"exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * (0.319381530 * {k} - 0.356563782 * pow({k}, 2) + 1.781477937 * pow({k}, 3) - 1.821255978 * pow({k}, 4) + 1.330274429 * pow({k}, 5))"
    return f"(case when {x} >= 0 then 1 - {t} else {t} end)"


@query(f"""with {TRADES}, x as (select exit_reason, entry_price as k, entry_price * (1 + pnl_pct / 100) as s, date_diff('day', entry_date, exit_date) / 365.0 as t from trades), d as (select *, case when t > 0 then (ln(s / k) + (0.04 + 0.38 * 0.38 / 2) * t) / (0.38 * sqrt(t)) end as d1 from x), e as (select *, d1 - 0.38 * sqrt(t) as d2 from d)
select exit_reason, count(*) as n, round(avg(case when t <= 0 then greatest(s - k, 0) else s * {_phi('d1')} - k * exp(-0.04 * t) * {_phi('d2')} end), 3) as value from e group by 1""")
def call_values(spark, d):
    """Calls at each trade's entry price, seen from its exit price with its days left."""
    t = Tables(spark, d).trades()
    v = finance.call_value(F.col("exit_price"), F.col("entry_price"), F.datediff("exit_date", "entry_date") / 365)
    return t.withColumn("v", v).groupBy("exit_reason").agg(F.count("*").alias("n"), F.round(F.avg("v"), 3).alias("value"))


@query(f"""with {TRADES}, f as (select *, entry_price * 1.0005 as e, entry_price * (1 + pnl_pct / 100) * 0.9995 as x from trades), p as (select exit_reason, round((x - e) * shares, 2) as pnl2, round((x - e) / e * 100, 2) as pct, date_diff('day', entry_date, exit_date) as held, least(greatest(abs(shares) * 0.005, 1.0), abs(shares) * x * 0.01) as fee from f)
select exit_reason, count(*) as n, round(sum(pnl2), 0) as pnl, round(avg(pct), 3) as pct, round(avg(held), 4) as held, round(sum(fee), 2) as fees from p group by 1""")
def trade_records(spark, d):
    t = Tables(spark, d).trades()
    e, x = finance.entry_fill(F.col("entry_price")), finance.exit_fill(F.col("exit_price"))
    y = t.select("exit_reason", finance.pnl(e, x, F.col("shares")).alias("p"), finance.pnl_pct(e, x).alias("c"), F.datediff("exit_date", "entry_date").alias("h"), finance.commission(F.col("shares"), x).alias("f"))
    return y.groupBy("exit_reason").agg(F.count("*").alias("n"), F.round(F.sum("p"), 0).alias("pnl"), F.round(F.avg("c"), 3).alias("pct"), F.round(F.avg("h"), 4).alias("held"), F.round(F.sum("f"), 2).alias("fees"))


# ------------------------------------------------------------------ time and joins


@query(f"""with {REGION}, m as (select min(date) as d from bars where date >= date '1995-01-01' group by date_trunc('month', date)), days as (select date, row_number() over (order by date) - 1 as before from (select distinct date from bars)) select d as review_date from m join days on d = date where before >= 252""")
def warmed_reviews(spark, d):
    days = Tables(spark, d).region().select("date").distinct()
    return T.warmed_up(T.review_dates(days, "1995-01-01", "2005-01-01"), days)


@query(f"with {REGION}, days as (select distinct date from bars), w as (select cast(x as date) as x from (select unnest(generate_series((select min(date) from days), (select max(date) from days), interval 1 day)) as x) where isodow(x) = 5) select distinct (select min(date) from days where date >= w.x) as review_date from w where exists (select 1 from days where date >= w.x)")
def friday_reviews(spark, d):
    return T.weekday_review_dates(Tables(spark, d).region().select("date").distinct(), 4)


@query(f"with {DAILY}, m as (select min(date) as review_date from bars group by date_trunc('month', date)), t as (select distinct ticker from bars) select t.ticker, review_date, (select max(date) from bars b where b.ticker = t.ticker and b.date < review_date) as score_date from m, t")
def review_score_dates(spark, d):
    bars = Tables(spark, d).daily()
    grid = bars.select("ticker").distinct().crossJoin(F.broadcast(T.review_dates(bars.select("date").distinct())))
    return T.previous_bar(grid, bars).select("ticker", "review_date", "score_date")


@query(f"""with {TRADES}, w as (select cast(date '1995-01-01' + to_months(cast(6 * k as integer)) as date) as a from (select unnest(range(40)) as k)), v as (select a as window_start, cast(a + interval 24 month as date) as window_end from w where a + interval 24 month <= date '2001-12-31')
select window_start, window_end, count(*) as n, round(avg(pnl_pct), 4) as avg_pnl from v join trades on entry_date >= window_start and entry_date < window_end group by 1, 2""")
def window_stats(spark, d):
    t = Tables(spark, d).trades()
    x = T.in_windows(t, T.rolling_windows(spark, "1995-01-01", "2001-12-31"), "entry_date", 24, 6)
    return x.groupBy("window_start", "window_end").agg(F.count("*").alias("n"), F.round(F.avg("pnl_pct"), 4).alias("avg_pnl"))


_CONFIGS = f"""with {TRADES}, w as (select cast(date '1995-01-01' + to_months(cast(6 * k as integer)) as date) as a from (select unnest(range(40)) as k)), v as (select a as window_start, cast(a + interval 24 month as date) as window_end from w where a + interval 24 month <= date '2001-12-31'),
r as (select regime as config, window_start, window_end, round(avg(pnl_pct), 6) as total_return from v join trades on entry_date >= window_start and entry_date < window_end group by 1, 2, 3)"""


@query(f"""{_CONFIGS}, b as (select *, total_return = max(total_return) over (partition by window_start) as best from r)
select config, count(*) as n, round(avg(total_return), 4) as mean, round(median(total_return), 4) as median, round(stddev_samp(total_return), 4) as std, round(100.0 * count(*) filter (where total_return > 0) / count(*), 4) as positive_pct, count(*) filter (where best) as wins from b group by 1""")
def config_windows(spark, d):
    x = T.in_windows(Tables(spark, d).trades(), T.rolling_windows(spark, "1995-01-01", "2001-12-31"), "entry_date", 24, 6)
    r_ = x.groupBy(F.col("regime").alias("config"), "window_start", "window_end").agg(F.round(F.avg("pnl_pct"), 6).alias("total_return"))
    return M.config_comparison(r_)


@query(f"""{_CONFIGS}, a as (select window_start, window_end, avg(pnl_pct) filter (where regime = 'bull') as bull, avg(pnl_pct) filter (where regime = 'bear') as bear, count(*) filter (where regime = 'bull') as bull_n, count(*) filter (where regime = 'bear') as bear_n
  from v join trades on entry_date >= window_start and entry_date < window_end group by 1, 2) select window_start, window_end, round(bull, 2) as bull_avg_pnl, round(bear, 2) as bear_avg_pnl, bull_n, bear_n, round(bull, 2) > round(bear, 2) as bull_wins from a where bull_n >= 5 and bear_n >= 5""")
def window_consistency(spark, d):
    return M.window_consistency(T.in_windows(Tables(spark, d).trades(), T.rolling_windows(spark, "1995-01-01", "2001-12-31"), "entry_date", 24, 6), "regime")


@query(f"with {MEMBERSHIP}, m as (select distinct cast(date_trunc('month', o_orderdate) as date) as d from orders) select d as date, count(distinct ticker) as members from m join membership on date_added <= d and (date_removed is null or date_removed >= d) group by 1")
def members_monthly(spark, d):
    t = Tables(spark, d)
    days = sql("select distinct cast(date_trunc('month', o_orderdate) as date) as date from ledgerline_orders", spark, d)
    return C.members_covered(t.membership(), days)


@query(f"with {MEMBERSHIP}, a as (select distinct ticker from membership where date_added <= date '1998-01-01' and (date_removed is null or date_removed > date '1998-01-01')), s as (select * from membership where ticker in (select ticker from a)) select 'current_list_naive' as arm, count(*) as n from a union all select 'pit', count(*) from membership union all select 'survivors_true_dates', count(*) from s")
def membership_arms(spark, d):
    arms = C.variants(Tables(spark, d).membership(), "1998-01-01")
    out = None
    for name, x in arms.items():
        if x is not None:
            one = x.agg(F.lit(name).alias("arm"), F.count("*").alias("n")).select("arm", "n")
            out = one if out is None else out.unionByName(one)
    return out


@query(f"with {REGION}, k as (select ticker, date, close / lag(close) over (partition by ticker order by date) - 1 as r, row_number() over (partition by ticker order by date desc) as back from bars), x as (select * from k where back <= 60 and r is not null) select a.ticker as a, b.ticker as b, count(*) as n, round(corr(a.r, b.r), 4) as corr, coalesce(abs(corr(a.r, b.r)) > 0.2, false) as rejected from x a join x b on a.date = b.date and a.ticker < b.ticker group by 1, 2 having count(*) >= 20")
def pairwise_correlations(spark, d):
    x = I.lookback(I.period_returns(Tables(spark, d).region(), "close", ["ticker"], "r"), 60).where("r is not null")
    c = CH.correlated(x, -1.0, 20, exact=True)
    return c.select("a", "b", "n", F.round("corr", 4).alias("corr"), F.coalesce(F.abs("corr") > 0.2, F.lit(False)).alias("rejected"))


_PAIRS = "rk as (select ticker, date, close / lag(close) over (partition by ticker order by date) - 1 as r, row_number() over (partition by ticker order by date desc) as back from bars), rx as (select * from rk where back <= 250 and r is not null), pc as (select a.ticker as a, b.ticker as b, count(*) as n, corr(a.r, b.r) as c from rx a join rx b on a.date = b.date and a.ticker < b.ticker group by 1, 2 having count(*) >= 20 and abs(corr(a.r, b.r)) > 0.12)"


@query(f"with {DAILY}, {_PAIRS} select a, b, n, round(c, 4) as corr from pc")
def correlated_pairs(spark, d):
    """By planes: at so low a limit nearly every pair has to be a candidate, so there are many short bands."""
    return _conflicts(spark, d).select("a", "b", "n", F.round("corr", 4).alias("corr"))


def _conflicts(spark, d) -> DataFrame:
    x = I.lookback(I.period_returns(Tables(spark, d).daily(), "close", ["ticker"], "r"), 250).where("r is not null")
    return CH.correlated(x, 0.12, 20, bands=40, bits=2)


@query(f"""with {PANEL}, {_PAIRS}, m as (select cast(date_trunc('month', date) as date) as mo, min(date) as rd from bars group by 1), seen_at as (select ticker, rd, max(date) as bar from m join panel on panel.date <= rd group by 1, 2),
snap as (select a.ticker, rd as date, p.sector, (0.3 * s_rsi + 0.2 * s_bb + 0.15 * s_mr + 0.1 * s_stochrsi + 0.1 * s_williams) / 0.85 as c from seen_at a join panel p on p.ticker = a.ticker and p.date = a.bar
  where i >= 256 and close > 0 and avg_volume >= 20 and rsi <= 50 and atr > 0 and pct_b is not null and stoch_k is not null and williams_r is not null),
ordered as (select *, row_number() over (partition by date order by round(c, 6) desc, ticker) as k from snap), ag as (select a, list(b) as against from (select a, b from pc union all select b, a from pc) group by 1),
o as (select ordered.*, coalesce(against, []) as against from ordered left join ag on ag.a = ordered.ticker), g as (with recursive g as (select date, 0 as k, cast([] as varchar[]) as names, cast([] as varchar[]) as sectors from (select distinct date from o)
  union all select g.date, g.k + 1, case when fits then list_append(names, o.ticker) else names end, case when fits then list_append(sectors, o.sector) else sectors end from (select g.*, o.ticker, o.sector, len(names) < 5 and len(list_filter(sectors, lambda s: s = o.sector)) < 2 and not list_has_any(names, o.against) as fits from g join o on o.date = g.date and o.k = g.k + 1) g join o on o.date = g.date and o.k = g.k + 1) select * from g),
last as (select date, names from g qualify row_number() over (partition by date order by k desc) = 1)
select date, cast(u.place as integer) as place, names[u.place] as ticker from last, (select unnest(range(1, 6)) as place) u where u.place <= len(names)""")
def greedy_choice(spark, d):
    """Each month the best five of the snapshots, two a sector, none correlated with another."""
    t = Tables(spark, d)
    sectors = t.bars("daily", K.daily(t.q), "sector").select("ticker", "sector").distinct()
    x = _snapshots(spark, d).join(sectors, "ticker").withColumn("score", F.round(S.composite(digits=None), 6))
    return CH.greedy(x.select("date", "ticker", "score", "sector"), 5, 2, _conflicts(spark, d))


@query(f"with {TRADES}, k as (select ticker, entry_date, l_orderkey, row_number() over (partition by ticker order by entry_date, l_orderkey, l_linenumber, l_partkey, l_suppkey) as k from trades) select ticker, entry_date from k where k = 1")
def first_appearances(spark, d):
    t = Tables(spark, d).trades()
    return t.groupBy("ticker").agg(F.min_by("entry_date", F.struct("entry_date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("entry_date"))


@query(f"with {TRADES}, x as (select case when entry_date between date '1997-02-20' and date '1997-04-07' then 'crash' else 'rest' end as part, pnl_pct from trades) select part, count(*) as n, round(avg(pnl_pct), 4) as avg_pnl from x group by 1")
def masked_range(spark, d):
    t = Tables(spark, d).trades()
    crash = T.clip(t, "1997-02-20", "1997-04-07", "entry_date").withColumn("part", F.lit("crash"))
    rest = t.where(~F.col("entry_date").between("1997-02-20", "1997-04-07")).withColumn("part", F.lit("rest"))
    return crash.unionByName(rest).groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg("pnl_pct"), 4).alias("avg_pnl"))


@query(f"with {TRADES} select count(*) as n, max(least(exit_date, date '1998-08-01')) as last_end from trades")
def clamped_ends(spark, d):
    return Tables(spark, d).trades().agg(F.count("*").alias("n"), F.max(T.clamp_to_pre_oos(F.col("exit_date"), "1998-08-01")).alias("last_end"))


# ------------------------------------------------------------------ trades and curves

_STATS = f"""with {TRADES}, {EQUITY}, m as (select count(*) as n, count(*) filter (where pnl > 0) as w, avg(pnl_pct) filter (where pnl > 0) as aw, avg(pnl_pct) filter (where pnl <= 0) as al, avg(pnl) as ea from trades),
c as (select date, portfolio_value as v, portfolio_value / lag(portfolio_value) over (order by date) - 1 - 0.04 / 12 as r, max(portfolio_value) over (order by date) as peak from equity),
s as (select avg(r) as mu, stddev_samp(r) as sd, stddev_samp(r) filter (where r < 0) as dn, min((v - peak) / peak) * 100 as dd, arg_max(v, date) / arg_min(v, date) as g, date_diff('day', min(date), max(date)) / 365.25 as y from c)"""


@query(f"""{_STATS} select n as n_trades, round(100.0 * w / n, 2) as win_rate, round(aw, 2) as avg_win, round(al, 2) as avg_loss, round(w * aw / abs((n - w) * al), 2) as profit_factor, round(w * aw / n + (n - w) * al / n, 2) as expectancy_pct, round(ea, 2) as expectancy_abs,
  round((g - 1) * 100, 2) as total_return, round((pow(g, 1 / y) - 1) * 100, 2) as annual_return, round(dd, 2) as max_drawdown, round(mu / sd * sqrt(12), 2) as sharpe_ratio, round(mu / dn * sqrt(12), 2) as sortino_ratio, round(round((pow(g, 1 / y) - 1) * 100, 2) / abs(dd), 2) as calmar_ratio from m, s""")
def standard_metrics(spark, d):
    t = Tables(spark, d)
    return M.standard_metrics(t.trades(), t.equity(), rf=0.04)


@query(f"""with {TRADES}, {EQUITY}, g as (select ticker, date_trunc('month', exit_date) as m, sum(pnl) as p from trades group by 1, 2), c as (select ticker, cast(m as date) as date, 1e7 + sum(p) over (partition by ticker order by m) as v from g),
f as (select *, v / lag(v) over (partition by ticker order by date) - 1 as r, max(v) over (partition by ticker order by date) as peak from c)
select ticker, round((arg_max(v, date) / arg_min(v, date) - 1) * 100, 2) as total_return, round(min((v - peak) / peak) * 100, 2) as max_drawdown, round(case when stddev_samp(r) > 0 then avg(r) / stddev_samp(r) * sqrt(12) else 0 end, 2) as sharpe_ratio,
  case when stddev_samp(r) filter (where r < 0) > 0 then round(avg(r) / (stddev_samp(r) filter (where r < 0)) * sqrt(12), 2) when avg(r) > 0 then 'inf'::double else 0 end as sortino_ratio from f group by 1""")
def metrics_by_ticker(spark, d):
    t = Tables(spark, d).trades()
    g = t.groupBy("ticker", F.trunc("exit_date", "month").alias("date")).agg(F.sum("pnl").alias("p"))
    curve = g.withColumn("portfolio_value", 1e7 + F.sum("p").over(I.by_ticker().rowsBetween(I.FIRST, 0)))
    return M.equity_stats(curve, by=["ticker"]).select("ticker", "total_return", "max_drawdown", "sharpe_ratio", "sortino_ratio")


_BUCKET = "case when signal_score > 0 and signal_score <= 6 then '0-6' when signal_score > 6 and signal_score <= 6.5 then '6-6.5' when signal_score > 6.5 and signal_score <= 7 then '6.5-7' when signal_score > 7 and signal_score <= 7.5 then '7-7.5' when signal_score > 7.5 and signal_score <= 10 then '7.5-10' end"


def _group(dim: str, key: str) -> str:
    return f"select '{dim}' as dimension, {key} as value, count(*) as n_trades, round(100.0 * count(*) filter (where pnl_pct > 0) / count(*), 4) as win_rate, round(avg(pnl_pct), 4) as avg_pnl, round(avg(pnl_pct) filter (where pnl_pct > 0), 4) as avg_win, round(avg(pnl_pct) filter (where pnl_pct <= 0), 4) as avg_loss, round(avg(date_diff('day', entry_date, exit_date)), 4) as avg_hold from trades group by 2"


@query(f"with {TRADES} {_group('regime', 'regime')} union all {_group('score', _BUCKET)} union all {_group('exit', 'exit_reason')}")
def signal_reliability(spark, d):
    return M.reliability(Tables(spark, d).trades())


@query(f"""with {TRADES}, m as (select regime, sector, count(*) as n, count(*) filter (where pnl > 0) as w, avg(pnl_pct) filter (where pnl > 0) as aw, avg(pnl_pct) filter (where pnl <= 0) as al, avg(pnl_pct) as mu, stddev_samp(pnl_pct) as sd from trades group by 1, 2)
select regime, sector, n as n_trades, round(100.0 * w / n, 2) as win_rate, round(mu, 2) as avg_pnl_pct, round(coalesce(w * aw / nullif(abs((n - w) * al), 0), 0), 2) as profit_factor, round(coalesce(mu / nullif(sd, 0), 0), 3) as trade_sharpe_approx from m""")
def stratified_stats(spark, d):
    return M.bucket_stats(Tables(spark, d).trades(), ["regime", "sector"])


@query(f"with {TRADES} select exit_reason, count(*) as n, round(cast(count(*) as double) / (select count(*) from trades), 4) as share from trades group by 1")
def exit_shares(spark, d):
    return M.shares(Tables(spark, d).trades(), "exit_reason")


_REASONS = ("stop_guard", "stop_breakeven", "stop_trail", "target_2", "score_deterioration", "delisted")


@query(f"""with {TRADES}, z as (select exit_reason, pnl_pct, -(signal_score / 2) as z from trades), b as (select *, case when z > -5 and z <= -2.5 then '(-5, -2.5]' when z > -2.5 and z <= -2 then '(-2.5, -2]' when z > -2 and z <= -1.5 then '(-2, -1.5]' when z > -1.5 and z <= -1 then '(-1.5, -1]' when z > -1 and z <= 0 then '(-1, 0]' end as z_bucket from z)
select z_bucket, {', '.join(f"round(count(*) filter (where exit_reason = '{x}') / cast(count(*) as double), 2) as {x}" for x in _REASONS)} from b where z_bucket is not null group by 1""")
def z_bucket_exits(spark, d):
    t = Tables(spark, d).trades().withColumn("z_bucket", S.z_bucket(-(F.col("signal_score") / 2)))
    return M.crosstab(t, "z_bucket", "exit_reason", _REASONS, share=True)


@query(f"with {TRADES}, m as (select strftime(entry_date, '%Y-%m') as m, count(*) as c from trades group by 1) select count(*) as months, cast(sum(c) as bigint) as n, (select count(distinct ticker) from trades) as tickers, round(100.0 * max(c) / sum(c), 4) as top_month_share, case when count(*) <= 3 or 100.0 * max(c) / sum(c) > 40 then 'concentrated' else 'spread_out' end as verdict from m")
def trade_concentration(spark, d):
    return M.concentration(Tables(spark, d).trades())


@query(f"with {TRADES}, x as (select case regime when 'bull' then 'broad' when 'bear' then 'narrow' else 'neutral' end as dispersion_bucket, pnl, pnl_pct, case regime when 'bear' then 0.7 else 1.0 end as m from trades) select dispersion_bucket, count(*) as n_trades, round(avg(pnl_pct), 2) as avg_pnl_pct, round(100.0 * count(*) filter (where pnl_pct > 0) / count(*), 2) as win_rate, round(sum(pnl), 0) as total_pnl, round(sum(pnl / m), 0) as total_undiscounted, round(avg(m), 2) as avg_size_mult from x group by 1")
def discount_costs(spark, d):
    t = Tables(spark, d).trades().withColumns({"dispersion_bucket": S.dispersion_bucket(F.col("regime")), "size_mult": F.when(F.col("regime") == "bear", 0.7).otherwise(1.0)})
    x = M.discount_cost(t)
    return x.select("dispersion_bucket", "n_trades", "avg_pnl_pct", "win_rate", F.round("total_pnl", 0).alias("total_pnl"), F.round("total_undiscounted", 0).alias("total_undiscounted"), "avg_size_mult")


@query(f"""with {O_COMPONENTS}, c as (select cast(date_trunc('month', date) as date) as month, regime, count(*) as n from components group by 1, 2), e as (select cast(date_trunc('month', date) as date) as month, dispersion_signal as s, count(*) as n from components where dispersion_signal is not null group by 1, 2),
a as (select month, regime from (select *, row_number() over (partition by month order by n desc, regime) as k from c) where k = 1), b as (select month, s from (select *, row_number() over (partition by month order by n desc, s) as k from e) where k = 1)
select a.month, a.regime, case s when 'bull' then 'broad' when 'neutral' then 'neutral' when 'bear' then 'narrow' else 'n/a' end as dispersion_bucket, round(m, 4) as dispersion from a left join b on a.month = b.month join (select cast(date_trunc('month', date) as date) as month, avg(dispersion) as m from components group by 1) d on d.month = a.month""")
def monthly_regimes(spark, d):
    return M.monthly_labels(Tables(spark, d).components())


@query(f"""with {DAILY}, {O_CAPS}, l as (select ticker, cast(date_trunc('month', date) as date) as month, arg_max(close, date) as c from bars group by 1, 2), m as (select l.*, (c / lag(c, 3) over (partition by ticker order by month) - 1) * 100 as ch from l),
g as (select month, coalesce(s.sector, 'Unknown') as sector, round(avg(ch), 6) as change from m join caps s on s.ticker = m.ticker where coalesce(s.sector, 'Unknown') <> 'Unknown' and ch is not null group by 1, 2) select month, sector, round(change, 2) as change, rank() over (partition by month order by change desc) as rank from g""")
def sector_strength(spark, d):
    t = Tables(spark, d)
    x = M.sector_strength(t.daily(), t.caps().withColumn("sector", F.coalesce("sector", F.lit("Unknown"))))
    return x.withColumn("change", F.round("change", 2))


@query(f"with {DAILY}, {K.trades(q)} select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(pnl, 4) as pnl, t.exit_date, b.close from trades t asof left join bars b on t.ticker = b.ticker and b.date <= t.exit_date")
def asof_in_ranges(spark, d):
    """The last close at each trade's exit, with the times of all tickers cut into 16 ranges."""
    t = Tables(spark, d)
    closes = t.daily().select("ticker", F.col("date").alias("exit_date"), "close")
    own = t.trades().select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pnl", "ticker", "exit_date")  # all that is carried through the join
    x = T.asof(own, closes, ["ticker"], "exit_date", ["close"], ranges=16)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("pnl", 4).alias("pnl"), "exit_date", "close")


@query(f"with {R_PANEL} select ticker, date, cast(i as bigint) as i, {r(4, 'rsi', 'pct_b', 'z_score', 'atr', 'stoch_k', 'williams_r', 'avg_volume')} from panel")
def lane_indicators(spark, d):
    """Indicators of the dense tickers in lanes of 512 bars."""
    x = lanes.indicators(Tables(spark, d).region(), size=512, ranges=8)
    return x.select("ticker", "date", "i", *[F.round(c, 4).alias(c) for c in ("rsi", "pct_b", "z_score", "atr", "stoch_k", "williams_r", "avg_volume")])


@query(f"""with {DAILY}, f as (select ticker, date, close, close / lag(close) over (partition by ticker order by date) - 1 as r, max(close) over (partition by ticker order by date) as peak from bars)
select ticker, round(min((close - peak) / peak) * 100, 2) as max_drawdown, round(avg(r) / stddev_samp(r) * sqrt(252), 2) as sharpe_ratio, round((arg_max(close, date) / arg_min(close, date) - 1) * 100, 2) as total_return from f group by 1""")
def curves_in_ranges(spark, d):
    """Statistics of each ticker as a curve, with its dates cut into 12 ranges."""
    x = Tables(spark, d).daily().select("ticker", "date", F.col("close").alias("portfolio_value"))
    return M.equity_stats(x, by=["ticker"], periods=252, ranges=12).select("ticker", "max_drawdown", "sharpe_ratio", "total_return")


@query(f"""with {DAILY}, f as (select ticker, close, max(close) over (partition by ticker order by date) as peak from bars) select ticker, max(close) as hi, min(close) as lo, round(min((close - peak) / peak) * 100, 6) as max_drawdown from f group by 1""")
def merged_drawdowns(spark, d):
    return ranges.drawdowns(Tables(spark, d).daily(), ["ticker"], "close", ranges=12).select("ticker", "hi", "lo", F.round("max_drawdown", 6).alias("max_drawdown"))


_SHARES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}


@query(f"with {TRADES} select exit_reason, " + ", ".join(f"round(quantile_cont(pnl, {v}), 4) as {k}" for k, v in _SHARES.items()) + " from trades group by 1")
def pnl_quantiles(spark, d):
    """Quantiles of the profits of each exit reason: nearly all are distinct values."""
    return order.quantiles(outcomes(spark, d), "pnl", _SHARES, ["exit_reason"], 32).select("exit_reason", *[F.round(k, 4).alias(k) for k in _SHARES])


@query(f"with {TRADES} select round(corr(pnl_pct, signal_score), 4) as score, round(corr(pnl_pct, shares), 4) as shares, round(corr(pnl_pct, entry_price), 4) as price from trades")
def pnl_correlations(spark, d):
    return Tables(spark, d).trades().agg(*[F.round(F.corr("pnl_pct", c), 4).alias(n) for n, c in (("score", "signal_score"), ("shares", "shares"), ("price", "entry_price"))])


@query(f"with {TRADES}, n as (select count(*) as n from trades), k as (select pnl_pct, row_number() over (order by pnl_pct) as k from trades) select count(*) + 2 * any_value(floor(0.05 * n)) as n, round(avg(pnl_pct), 4) as trimmed from k, n where k > floor(0.05 * n) and k <= n - floor(0.05 * n)")
def trimmed_mean_by_counts(spark, d):
    return M.trimmed_mean(outcomes(spark, d)).select(F.col("n").cast("double").alias("n"), "trimmed")


@query(f"with {TRADES}, k as (select rank() over (order by signal_score) + (count(*) over (partition by signal_score) - 1) / 2.0 as a, rank() over (order by pnl_pct) + (count(*) over (partition by pnl_pct) - 1) / 2.0 as b from trades) select round(corr(a, b), 4) as rho from k")
def spearman_by_counts(spark, d):
    return M.spearman(outcomes(spark, d), "signal_score", "pnl_pct")


@query(f"""with {TRADES}, a as (select pnl_pct, row_number() over (order by pnl_pct desc) as k from trades), b as (select pnl, row_number() over (order by pnl desc) as k from trades), t as (select unnest([1, 3, 5, 10]) as kk)
select cast(kk as bigint) as k, round((select avg(pnl_pct) from a where a.k > kk), 4) as mean_without, round((select sum(pnl) from b where b.k <= kk) / (select sum(pnl) from trades), 4) as share_of_pnl from t""")
def top_removed(spark, d):
    return M.top_removed(outcomes(spark, d))


@query(f"with c as (select c_custkey as ticker, c_acctbal * 1e8 as market_cap from customer), t as (select *, {K.tier('market_cap')} as cap_tier from c) select cap_tier, count(*) over (partition by cap_tier) as n, row_number() over (partition by cap_tier order by market_cap desc, ticker) as place, ticker, market_cap from t")
def cap_tier_members(spark, d):
    return M.tier_listing(sql("select c_custkey as ticker, c_acctbal * 1e8 as market_cap from ledgerline_customer", spark, d))


@query(f"with {TRADES}, e as (select min(pnl_pct) as lo, max(pnl_pct) as hi from trades), b as (select least(cast(floor((pnl_pct - lo) / ((hi - lo) / 25)) as bigint), 24) as bin from trades, e) select bin, count(*) as n from b group by 1")
def pnl_histogram(spark, d):
    return D.histogram(outcomes(spark, d), "pnl_pct").select("bin", "n")


@query(f"with {MEMBERSHIP} select distinct ticker from (select distinct ticker from membership) order by md5('7:' || ticker), ticker limit 40")
def thinned_universe(spark, d):
    return C.universe_sample(Tables(spark, d).membership(), 40, 7)


# ------------------------------------------------------------------ exits


def _three_phase(fill: str) -> str:
    return f"""with {R_PANEL}, e as (select ticker, i as ei, date as entry_date, close as entry_price, round(atr, 2) as atr, round(close + 4 * atr, 2) as target_2 from panel where i >= 257 and rsi <= 50 and atr > 0),
p as (select e.*, b.i, b.date, b.open, b.high, b.low, b.close, date_diff('day', entry_date, b.date) as held, greatest(entry_price, max(b.high) over (partition by e.ticker, e.ei order by b.i)) as peak from e join panel b on b.ticker = e.ticker and b.i > ei and b.i <= ei + 60),
s as (select *, peak >= entry_price + atr as won, case when held < 15 then entry_price - 3 * atr when peak >= entry_price + atr then greatest(peak - 2.5 * atr, entry_price) else entry_price end as stop from p),
h as (select *, case when low <= stop then 'stop_' || case when held < 15 then 'guard' when won then 'trail' else 'breakeven' end when high >= target_2 then 'target_2' when held >= 40 then 'max_hold' end as reason from s),
f as (select *, row_number() over (partition by ticker, ei order by i) as k from h where reason is not null)
select ticker, entry_date, date as exit_date, reason as exit_reason, round(case when reason like 'stop%' then round({fill}, 2) when reason = 'target_2' then target_2 else close end, 1) as exit_price from f where k = 1"""


def _entries(spark, d):
    x = I.indicators(Tables(spark, d).region())
    own = x.where("i >= 257 and rsi <= 50 and atr > 0").select("ticker", F.col("date").alias("entry_date"), F.col("close").alias("entry_price"), F.round("atr", 2).alias("atr"), F.round(F.col("close") + 4 * F.col("atr"), 2).alias("target_2"))
    return own, I.numbered(Tables(spark, d).region())


@query(_three_phase("stop"))
def three_phase_exits(spark, d):
    own, bars = _entries(spark, d)
    return X.three_phase(own, bars, 40, 60).where("exit_reason is not null").select("ticker", "entry_date", "exit_date", "exit_reason", F.round("exit_price", 1).alias("exit_price"))


@query(_three_phase("least(stop, open)"))
def three_phase_gap_fills(spark, d):
    own, bars = _entries(spark, d)
    return X.three_phase(own, bars, 40, 60, realistic_fills=True).where("exit_reason is not null").select("ticker", "entry_date", "exit_date", "exit_reason", F.round("exit_price", 1).alias("exit_price"))


_SWEEP = (_three_phase("stop").replace("from e join panel b", "from (select * from e, (select unnest([1.5, 2.5, 3.5]) as trail) ct, (select unnest([0.5, 1.0]) as trigger) cg) e join panel b").replace("partition by e.ticker, e.ei order", "partition by e.ticker, e.ei, trail, trigger order")
    .replace("entry_price + atr as won", "entry_price + trigger * atr as won").replace("peak >= entry_price + atr then greatest(peak - 2.5 * atr", "peak >= entry_price + trigger * atr then greatest(peak - trail * atr").replace("partition by ticker, ei order", "partition by ticker, ei, trail, trigger order"))
_SWEEP = _SWEEP[: _SWEEP.rindex("select ticker, entry_date, date as exit_date")]


@query(f"""{_SWEEP}, z as (select trail, trigger, reason, (case when reason like 'stop%' then round(stop, 2) when reason = 'target_2' then target_2 else close end - entry_price) / entry_price * 100 as pnl from f where k = 1)
select cast(trigger as double) as trigger, {', '.join(f"round(avg(pnl) filter (where trail = {t}), 3) as trail_{str(t).replace('.', '_')}" for t in (1.5, 2.5, 3.5))}, count(*) as n, count(*) filter (where reason = 'stop_trail') as n_trail from z group by 1""")
def exit_sweep(spark, d):
    """Exits of the same entries under a grid of trails and triggers: mean profit by cell."""
    own, bars = _entries(spark, d)
    grid = F.array(*[F.struct(F.lit(t).alias("trail"), F.lit(g).alias("trigger")) for t in (1.5, 2.5, 3.5) for g in (0.5, 1.0)])
    cells = X.three_phase(own.withColumn("c_", F.explode(grid)).select(*own.columns, "c_.*"), bars, 40, 60, trail=F.col("trail"), trigger=F.col("trigger")).where("exit_reason is not null")
    cells = cells.withColumn("trail", F.concat(F.lit("trail_"), F.translate(F.col("trail").cast("string"), ".", "_")))
    cells = cells.withColumn("pnl", (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price") * 100)
    means = M.pivot_mean(cells, "trail", "trigger", "pnl", ["trail_1_5", "trail_2_5", "trail_3_5"], 3)
    return means.join(cells.groupBy("trigger").agg(F.count("*").alias("n"), F.count_if(F.col("exit_reason") == "stop_trail").alias("n_trail")), "trigger")


_CONFIG_ROWS = (("bull", 6.0, 5, 1.5, 4.0, 365, 0.0), ("neutral", 6.5, 4, 1.5, 4.0, 200, 0.1), ("bear", 7.5, 2, 1.0, 3.0, 90, 0.3))


@query(f"""with {REGION}, {O_COMPONENTS}, cf as (select * from (values {', '.join(map(str, _CONFIG_ROWS))}) t(name, signal_threshold, top_n, stop_atr_mult, target_atr_mult, max_hold_days, cash_pct)), rv as (select min(date) as review_date from bars group by date_trunc('month', date)),
l as (select rv.review_date, coalesce((select regime from components c where c.date <= rv.review_date order by c.date desc limit 1), 'neutral') as name from rv)
select review_date, name, cast(signal_threshold as double) as signal_threshold, top_n, cast(stop_atr_mult as double) as stop_atr_mult, cast(target_atr_mult as double) as target_atr_mult, max_hold_days, cast(cash_pct as double) as cash_pct from l join cf using (name)""")
def regime_configs(spark, d):
    """The configuration in force at each monthly review."""
    t = Tables(spark, d)
    configs = spark.createDataFrame(_CONFIG_ROWS, "name string, signal_threshold double, top_n int, stop_atr_mult double, target_atr_mult double, max_hold_days int, cash_pct double")
    return T.config_on(T.review_dates(t.region().select("date").distinct()), t.components(), configs)


def _call(s: str) -> str:
    d1 = f"((ln({s} / e) + (0.04 + 0.38 * 0.38 / 2) * t) / (0.38 * sqrt(t)))"
    return f"({s} * {_phi(d1)} - e * exp(-0.04 * t) * {_phi(f'({d1} - 0.38 * sqrt(t))')})"


_PATHS = f"""with {R_PANEL}, z as (select ticker, date as signal_date, i from panel where i >= 257), n as (select ticker, max(i) as last from panel group by 1),
e as (select z.ticker, signal_date, b.i as ei, b.date as entry_date, b.open as e, least(40, last - b.i) as days from z join panel b on b.ticker = z.ticker and b.i = z.i + 1 join n on n.ticker = z.ticker where last - b.i >= 5),
q0 as (select *, 45.0 / 365 as t from e), q1 as (select *, {_call('e')} as premium from q0),
p as (select q1.* exclude (t), b.i - ei as k, b.date, b.low as bl, b.close as bc, b.high as bh, greatest(45 - (b.i - ei), 1) / 365.0 as t from q1 join panel b on b.ticker = q1.ticker and b.i > ei and b.i <= ei + days),
v as (select *, {_call('bl')} as vl, {_call('bh')} as vh, {_call('bc')} as vc from p),
w as (select *, max(case when k > 5 then vc end) over (partition by ticker, signal_date order by k) as peak, max(case when k > 5 and vh >= premium * 1.15 then 1 else 0 end) over (partition by ticker, signal_date order by k) as armed from v),
h as (select *, case when k <= 5 and vl <= premium * 0.6 then 'guard_floor' when k > 5 and vl <= premium * 0.8 then 'stop_loss' when k > 5 and armed = 1 and vc <= peak * 0.95 then 'trailing_stop' when k = days then 'time_exit' end as reason from w),
g as (select *, row_number() over (partition by ticker, signal_date order by k) as f from h where reason is not null),
res as (select ticker, signal_date, entry_date, date as exit_date, cast(k as integer) as days_held, reason as exit_reason, round(premium, 2) as entry_premium, round((case reason when 'guard_floor' then premium * 0.6 when 'stop_loss' then premium * 0.8 when 'trailing_stop' then peak * 0.95 else vc end - premium) / premium * 100, 2) as option_pnl_pct,
  round((case when reason in ('guard_floor', 'stop_loss') then bl else bc end - e) / e * 100, 2) as stock_pnl_pct from g where f = 1)"""


def _paths(spark, d):
    x = I.numbered(Tables(spark, d).region())
    return X.option_paths(x.where("i >= 257").select("ticker", F.col("date").alias("signal_date")), x)


@query(f"{_PATHS} select * from res")
def option_paths(spark, d):
    return _paths(spark, d).select("ticker", "signal_date", "entry_date", "exit_date", "days_held", "exit_reason", "entry_premium", "option_pnl_pct", "stock_pnl_pct")


@query(f"{_PATHS} select exit_reason, count(*) as n, round(100.0 * count(*) / (select count(*) from res), 1) as pct_of_total, round(avg(option_pnl_pct), 2) as avg_option_pnl, round(avg(stock_pnl_pct), 2) as avg_stock_pnl, round(median(option_pnl_pct), 2) as median_option_pnl, round(100.0 * count(*) filter (where option_pnl_pct > 0) / count(*), 1) as win_rate_option, round(avg(days_held), 1) as avg_days_held from res group by rollup (exit_reason)")
def option_summary(spark, d):
    return X.option_summary(_paths(spark, d)).drop("win_rate_stock", "pct_armed")


_FORENSICS = f"""with {TRADES}, {K.bars(q, 'bars', 'n_name')}, s as (select *, entry_price * (1 + pnl_pct / 100) as exit_price from trades where exit_reason like 'stop_%'), u as (select distinct ticker, exit_date, exit_price from s),
f as (select u.*, b.date, low, close, date_diff('day', exit_date, b.date) as n, row_number() over (partition by u.ticker, exit_date, exit_price order by b.date) as k from u join bars b on b.ticker = u.ticker and b.date > exit_date and b.date <= exit_date + 80),
a as (select ticker, exit_date, exit_price, {', '.join(f'round((arg_max(close, date) filter (where n <= {w}) - exit_price) / exit_price * 100, 2) as fwd_{w}d' for w in (20, 40, 60))}, round((min(low) filter (where k <= 20) - exit_price) / exit_price * 100, 2) as mae_post, min(n) filter (where k <= 20 and low < exit_price) as days_to_new_low from f group by 1, 2, 3),
st as (select s.exit_reason, s.pnl_pct, a.* from s join a on a.ticker = s.ticker and a.exit_date = s.exit_date and a.exit_price = s.exit_price)"""


@query(f"{_FORENSICS} select exit_reason, count(*) as n, {', '.join(f'round(avg(fwd_{w}d), 3) as f{w}' for w in (20, 40, 60))}, round(avg(mae_post), 3) as mae, round(avg(days_to_new_low), 4) as days from st group by 1")
def forensics_by_reason(spark, d):
    t = Tables(spark, d)
    x = X.stop_forensics(t.trades(), t.daily())
    return x.groupBy("exit_reason").agg(F.count("*").alias("n"), *[F.round(F.avg(f"fwd_{w}d"), 3).alias(f"f{w}") for w in (20, 40, 60)], F.round(F.avg("mae_post"), 3).alias("mae"), F.round(F.avg("days_to_new_low"), 4).alias("days"))


@query(f"""{_FORENSICS}, l as ({' union all '.join(f'select exit_reason, {w} as "window", pnl_pct, mae_post, fwd_{w}d as fwd from st' for w in (20, 40, 60))}), g as (select exit_reason, "window", count(*) as n, 100.0 * count(*) filter (where fwd > 0) / count(fwd) as up, median(fwd) as md from l group by 1, 2)
select exit_reason, "window", n, round(up, 4) as pct_up, round(md, 2) as median_fwd, case when "window" = 40 then case when up >= case exit_reason when 'stop_breakeven' then 65 when 'stop_guard' then 60 else 55 end then case when exit_reason = 'stop_trail' then 'borderline' else 'issue' end when exit_reason = 'stop_breakeven' and up >= 50 then 'borderline' else 'ok' end end as verdict from g""")
def forensics_verdicts(spark, d):
    t = Tables(spark, d)
    x = X.forensics_summary(X.stop_forensics(t.trades(), t.daily()))
    return x.select("exit_reason", "window", "n", "pct_up", F.round("median_fwd", 2).alias("median_fwd"), "verdict")


@query(f"""with {TRADES}, {K.bars(q, 'bars', 'n_name')}, s as (select t.*, entry_price * (1 + pnl_pct / 100) / 0.9995 as raw, b.open as o from trades t left join bars b on b.ticker = t.ticker and b.date = exit_date where exit_reason like 'stop_%'), g as (select *, case when o < raw then (o - raw) / entry_price * 100 when o is not null then 0 end as x from s)
select count(*) as n_stop_exits, count(x) as n_checked, count(*) filter (where x < 0) as n_gapped_through, round(100.0 * count(*) filter (where x < 0) / count(x), 4) as share_gapped_pct, round(avg(x) filter (where x < 0), 4) as mean_extra_loss from g""")
def stop_gap_check(spark, d):
    t = Tables(spark, d)
    trades = t.trades()
    return X.stop_gap_summary(X.stop_gap(trades, t.daily()), trades.count()).drop("expectancy_impact_pp")


@query(f"""with {TRADES}, {K.bars(q, 'bars', 'n_name')}, s as (select t.regime, t.pnl_pct, case when exit_reason like 'stop_%' and b.open < entry_price * (1 + pnl_pct / 100) / 0.9995 then (b.open - entry_price * (1 + pnl_pct / 100) / 0.9995) / entry_price * 100 else 0 end as x from trades t left join bars b on b.ticker = t.ticker and b.date = exit_date)
select regime, round(avg(pnl_pct), 4) as before, round(avg(pnl_pct + x), 4) as after from s group by 1""")
def gap_corrected(spark, d):
    t = Tables(spark, d)
    x = X.with_stop_gap(t.trades(), t.daily()).withColumn("adj", F.col("pnl_pct") + F.coalesce("gap_extra_pct", F.lit(0.0)))
    return x.groupBy("regime").agg(F.round(F.avg("pnl_pct"), 4).alias("before"), F.round(F.avg("adj"), 4).alias("after"))


_INSPECTED = f"with {PANEL}, {TRADES}, own as (select ticker, date, rsi, z_score, williams_r from panel where i >= 67), j as (select t.*, o.rsi, o.z_score, o.williams_r from trades t asof left join own o on t.ticker = o.ticker and t.entry_date >= o.date)"


@query(f"{_INSPECTED} select exit_reason, count(*) as n, count(rsi) as scored, round(avg(rsi), 3) as rsi, round(stddev_samp(z_score), 3) as z_sd, round(median(williams_r), 3) as williams from j group by 1")
def inspected_trades(spark, d):
    t = Tables(spark, d)
    x = SC.inspect(t.trades(), t.daily())
    return x.groupBy("exit_reason").agg(F.count("*").alias("n"), F.count("rsi").alias("scored"), F.round(F.avg("rsi"), 3).alias("rsi"), F.round(F.stddev_samp("z_score"), 3).alias("z_sd"), F.round(F.percentile("williams_r", 0.5), 3).alias("williams"))


@query(f"{_INSPECTED} select round(corr(pnl_pct, rsi), 4) as rsi, round(corr(pnl_pct, z_score), 4) as z_score, round(corr(pnl_pct, williams_r), 4) as williams_r from j")
def inspected_correlations(spark, d):
    t = Tables(spark, d)
    return SC.inspect(t.trades(), t.daily()).agg(*[F.round(F.corr("pnl_pct", c), 4).alias(c) for c in ("rsi", "z_score", "williams_r")])


# ------------------------------------------------------------------ the ledger

_LEDGER = f"with {TRADES}, {POSITIONS}, {K.bars(q, 'bars', 'n_name')}, {K.bars(q, 'rbars', 'r_name')}, bench as (select date, close from rbars where ticker = 'EUROPE'), last as (select ticker, arg_max(close, date) as price from bars group by 1)"
_BENCH = "ticker = 'EUROPE'"


@query(f"{_LEDGER}, x as (select 10000 - coalesce(sum(entry_price * shares) filter (where status = 'open'), 0) + coalesce(sum((exit_price - entry_price) * shares) filter (where status = 'closed'), 0) as cash, sum(price * shares) filter (where status = 'open') as v, count(*) filter (where status = 'open') as n from positions p left join last l on l.ticker = p.ticker) select round(cash, 2) as cash, round(v, 2) as open_value, round(cash + v, 2) as total_value, n as n_open from x")
def marked_portfolio(spark, d):
    t = Tables(spark, d)
    return L.portfolio_value(t.held(), t.daily())


@query(f"{_LEDGER} select p.ticker, round(price, 2) as current_price, stop_loss, target, case when price <= stop_loss then 'below stop_loss' when price >= target then 'target reached' end as flag from positions p join last l on l.ticker = p.ticker where status = 'open' and (price <= stop_loss or price >= target)")
def exit_suggestions(spark, d):
    t = Tables(spark, d)
    return L.exit_suggestions(t.held(), t.daily())


@query(f"{_LEDGER} select round(10000 / arg_min(close, date) * arg_max(close, date), 2) as benchmark_value from bench where date >= (select min(entry_date) from positions)")
def benchmark_equivalent(spark, d):
    t = Tables(spark, d)
    return L.benchmark_value(t.held(), t.region().where(_BENCH))


_BACKFILL = f"""{_LEDGER}, d0 as (select date, close from bench where date >= (select min(entry_date) from positions)), x as (select d.date, d.close as b, p.*, (select close from bars m where m.ticker = p.ticker and m.date <= d.date order by m.date desc limit 1) as mark from d0 d left join positions p on p.entry_date <= d.date),
y as (select date, any_value(b) as b, sum(case when exit_date is not null and exit_date <= date then (exit_price - entry_price) * shares when ticker is not null then -entry_price * shares + coalesce(mark * shares, 0) else 0 end) as v, count(*) filter (where ticker is not null and (exit_date is null or exit_date > date) and mark is not null) as n from x group by 1),
hist as (select strftime(date, '%Y-%m-%d') as date, round(round(10000 + v, 2), 0) as portfolio_value, round(10000 / (select arg_min(close, date) from d0) * b, 2) as spy_equivalent_value, n as n_open_positions from y)"""


@query(f"{_BACKFILL} select * from hist")
def backfilled_history(spark, d):
    t = Tables(spark, d)
    return L.backfill(t.held(), t.daily(), t.region().where(_BENCH)).select("date", F.round("portfolio_value", 0).alias("portfolio_value"), "spy_equivalent_value", "n_open_positions")


@query(f"{_BACKFILL}, n as (select date, portfolio_value + 1 as portfolio_value from hist where date like '1997-0%' union all select '2999-01-01', 5.0) select * from n union all select date, portfolio_value from hist where date not in (select date from n)")
def upserted_history(spark, d):
    t = Tables(spark, d)
    h = kept(L.backfill(t.held(), t.daily(), t.region().where(_BENCH)).select("date", F.round("portfolio_value", 0).alias("portfolio_value")), "history")
    new = h.where("date like '1997-0%'").withColumn("portfolio_value", F.col("portfolio_value") + 1).unionByName(spark.createDataFrame([("2999-01-01", 5.0)], "date string, portfolio_value double"))
    return L.upsert(h, new)


_TRACK = f"""{_LEDGER}, p as (select p.*, case when status = 'closed' then exit_price else price end as now, case when status = 'closed' then exit_date else date '1998-12-31' end as fin from positions p left join last l on l.ticker = p.ticker),
e as (select p.*, (select min(date) from bench where date >= entry_date) as a, (select max(date) from bench where date <= fin) as z from p where now is not null), t as (select e.*, b0.close as c0, b1.close as c1 from e join bench b0 on b0.date = a join bench b1 on b1.date = z where a <= z),
r as (select ticker, status, entry_date, round(round(now, 2), 0) as price_now, round((now - entry_price) / entry_price * 100, 2) as return_pct, round((c1 - c0) / c0 * 100, 2) as benchmark_return_pct, round((now - entry_price) / entry_price * 100 - (c1 - c0) / c0 * 100, 2) as alpha_pct from t)"""


@query(f"{_TRACK} select * from r")
def tracked_positions(spark, d):
    t = Tables(spark, d)
    return L.track(t.held(), t.daily(), t.region().where(_BENCH), "1998-12-31").drop("entry_price").withColumn("price_now", F.round("price_now", 0))


@query(f"{_TRACK} select count(*) as n, round(avg(alpha_pct), 4) as avg_alpha_pct, round(100.0 * count(*) filter (where alpha_pct > 0) / count(*), 4) as beat_rate_pct from r")
def track_record(spark, d):
    t = Tables(spark, d)
    return L.track_summary(L.track(t.held(), t.daily(), t.region().where(_BENCH), "1998-12-31"))


# ------------------------------------------------------------------ coverage and survivorship

_SPANS = f"""with {MEMBERSHIP}, {TRADES}, seen as (select o_custkey as ticker, min(cast(o_orderdate as date)) as fv, max(cast(o_orderdate as date)) as lv from orders where o_orderstatus <> 'P' group by 1), act as (select distinct ticker from membership where date_added <= date '2000-06-01' and (date_removed is null or date_removed > date '2000-06-01')),
m as (select ticker, greatest(date_added, date '1996-01-01') as b, least(coalesce(date_removed, date '2000-12-31'), date '2000-12-31') as e from membership), s as (select m.ticker, b, e, fv, lv, act.ticker is not null as sv, date_diff('day', b, e) as days, case when fv is null then 0 else least(greatest(date_diff('day', greatest(b, fv), least(e, lv)), 0), date_diff('day', b, e)) end as cov
  from m left join seen on seen.ticker = m.ticker left join act on act.ticker = m.ticker where e > b), pt as (select ticker, sum(days) as days, sum(cov) as cov, bool_or(sv) as sv, min(b) as first_member, max(e) as last_member from s group by 1)"""


def _spans(spark, d) -> DataFrame:
    t = Tables(spark, d)
    return C.spans(t.membership(), t.seen(), "1996-01-01", "2000-12-31", "2000-06-01")


def _cover(where: str, name: str) -> str:
    return f"select '{name}' as \"group\", count(*) as n_tickers, cast(sum(days) as bigint) as company_days, cast(sum(cov) as bigint) as covered_days, round(100.0 * sum(cov) / sum(days), 4) as coverage_pct, count(*) filter (where cov = 0) as n_fully_missing, count(*) filter (where cov > 0 and cov < days * 0.98) as n_partial from pt where {where}"


@query(f"{_SPANS} {_cover('true', 'all')} union all {_cover('sv', 'survivors')} union all {_cover('not sv', 'non_survivors')}")
def coverage_groups(spark, d):
    return C.coverage(_spans(spark, d))


@query(f"{_SPANS}, g as (select 100.0 * sum(cov) filter (where sv) / sum(days) filter (where sv) as a, 100.0 * sum(cov) filter (where not sv) / sum(days) filter (where not sv) as b from pt) select round(round(a, 4) - round(b, 4), 4) as gap, case when a - b > 2 then 'tilt' when a - b < -2 then 'no_tilt' else 'negligible' end as verdict from g")
def coverage_tilt(spark, d):
    return C.coverage_verdict(C.coverage(_spans(spark, d)))


@query(f"""{_SPANS}, y as (select unnest(range(1996, 2001)) as year), x as (select year, sv, greatest(date_diff('day', greatest(b, make_date(year, 1, 1)), least(e, make_date(year, 12, 31))), 0) as d0, case when fv is null then 0 else greatest(date_diff('day', greatest(b, make_date(year, 1, 1), fv), least(e, make_date(year, 12, 31), lv)), 0) end as c0 from s, y)
select cast(year as integer) as year, cast(sum(d0) as bigint) as company_days, round((1 - sum(c0) / sum(d0)) * 100, 4) as missing_pct_all, round((1 - sum(c0) filter (where sv) / sum(d0) filter (where sv)) * 100, 4) as missing_pct_survivors, round((1 - sum(c0) filter (where not sv) / sum(d0) filter (where not sv)) * 100, 4) as missing_pct_non_survivors from x group by 1""")
def coverage_by_year(spark, d):
    return C.coverage_by_year(_spans(spark, d))


_BY_DATE = f"{_SPANS}, dd as (select cast(unnest(generate_series(date '1996-01-01', date '2000-12-01', interval 1 month)) as date) as date), bd as (select date, count(*) as n_members, count(*) filter (where date between fv and lv) as n_covered from dd join s on date between b and e group by 1)"


def _by_date(spark, d) -> DataFrame:
    days = spark.range(1).select(F.explode(F.expr("sequence(date '1996-01-01', date '2000-12-01', interval 1 month)")).alias("date"))
    return C.coverage_by_date(_spans(spark, d), days)


@query(f"{_BY_DATE} select date, n_members, n_covered, round(1 - cast(n_covered as double) / n_members, 4) as missing_share from bd")
def coverage_by_date(spark, d):
    return _by_date(spark, d)


@query(f"{_SPANS} select ticker, cast(days as bigint) as days, cast(cov as bigint) as covered, cast(days - cov as bigint) as missing_days from pt where cov > 0 and cov < days * 0.98 order by days - cov desc, ticker limit 15")
def worst_covered(spark, d):
    return C.worst_partial(_spans(spark, d))


@query(f"{_SPANS}, k as (select * from pt where cov = 0) select ticker, first_member, last_member, cast(days as bigint) as member_days, round(100.0 * days / sum(days) over (), 4) as pct_of_missing, round(100.0 * sum(days) over (order by days desc, ticker rows unbounded preceding) / sum(days) over (), 4) as cum_pct from k")
def missing_ranking(spark, d):
    return C.missing_ranking(_spans(spark, d))


def _customer_trades(spark, d) -> DataFrame:
    t = Tables(spark, d).trades()
    return t.withColumn("ticker", F.col("l_orderkey") % 977)


_CT = f"{_SPANS}, ct as (select *  exclude (ticker), l_orderkey % 977 as ticker from trades)"


@query(f"""{_CT}, x as (select ct.*, act.ticker is not null as is_survivor from ct left join act on act.ticker = ct.ticker) select is_survivor, count(*) as n, round(avg(pnl_pct), 4) as mean, round(median(pnl_pct), 4) as median, round(100.0 * count(*) filter (where pnl_pct > 0) / count(*), 4) as win_rate, round(avg(date_diff('day', entry_date, exit_date)), 4) as avg_hold_days,
  count(*) filter (where exit_reason = 'delisted') as n_delisted_exits, count(*) filter (where exit_reason = 'stop_guard') as n_stop_guard_exits, round(100.0 * count(*) / (select count(*) from ct), 4) as share_trades from x group by 1""")
def survivor_split(spark, d):
    x = C.attribution(_customer_trades(spark, d), Tables(spark, d).membership(), "2000-06-01")
    return x.select("is_survivor", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "win_rate", "avg_hold_days")], "n_delisted_exits", "n_stop_guard_exits", F.round("share_trades", 4).alias("share_trades"))


@query(f"{_CT} select distinct ct.ticker from ct where ct.ticker not in (select ticker from membership where date_added >= date '1996-01-01')")
def unknown_tickers(spark, d):
    """Traded tickers that no interval from 1996 on knows."""
    return C.unknown_tickers(_customer_trades(spark, d), Tables(spark, d).membership().where("date_added >= date '1996-01-01'"))


@query(f"""{_CT}, k as (select ct.*, act.ticker is null as gone from ct left join act on act.ticker = ct.ticker where ct.ticker in (select ticker from membership)), a as (select count(*) as n, avg(case when gone then 1.0 else 0.0 end) as st from k), b as (select cast(sum(cov) filter (where not sv) as double) / sum(cov) as sd from pt)
select n as n_trades, round(st, 6) as share_trades_non_survivor, round(sd, 6) as share_days_non_survivor, round((st / (1 - st)) / (sd / (1 - sd)), 6) as k_empirical from a, b""")
def selection_odds(spark, d):
    return C.selection_propensity(_customer_trades(spark, d), Tables(spark, d).membership(), C.coverage(_spans(spark, d)), "2000-06-01")


_BOUND = f"""{_BY_DATE}, en as (select cast(date_trunc('month', entry_date) as date) as mo, count(*) as c from trades group by 1), g as (select sum(c * coalesce((n_members - n_covered) / cast(nullif(n_covered, 0) as double), 0)) as ghost from en left join bd on bd.date = mo), t as (select count(*) as n, avg(pnl_pct) as mu, avg(pnl_pct) filter (where exit_reason = 'stop_guard') as gu, avg(pnl_pct) filter (where exit_reason = 'delisted') as de from trades),
sc as (select '-30% (gap through the stop)' as scenario, -30.0 as x from t union all select '-60% (distress)', -60.0 from t union all select '-100% (bankruptcy)', -100.0 from t union all select 'avg stop_guard exit', gu from t union all select 'avg delisted exit', de from t), kk as (select unnest([1.0, 2.0, 3.0]) as k)"""


@query(f"{_BOUND} select cast(k as double) as k, scenario, round(ghost * k, 4) as ghost_trades, round(x, 4) as ghost_return_pct, round((n * mu + ghost * k * x) / (n + ghost * k), 4) as adj_expectancy_pct, round(case when ghost > 0 and mu > 0 then -n * mu / (ghost * k) end, 4) as breakeven_pct from sc, kk, g, t")
def missing_data_bound(spark, d):
    return C.missing_data_bound(Tables(spark, d).trades(), _by_date(spark, d)).drop("delta_pp")


@query(f"{_BOUND} select scenario, " + ", ".join(f"round(max((n * mu + ghost * k * x) / (n + ghost * k)) filter (where k = {k}), 4) as k{k}" for k in (1, 2, 3)) + " from sc, kk, g, t group by 1")
def missing_data_pivot(spark, d):
    x = C.missing_data_bound(Tables(spark, d).trades(), _by_date(spark, d)).withColumn("k", F.concat(F.lit("k"), F.col("k").cast("int")))
    return M.pivot_mean(x, "k", "scenario", "adj_expectancy_pct", ["k1", "k2", "k3"])


@query(f"with {TRADES}, {K.bars(q, 'bars', 'n_name')}, l as (select ticker, max(date) as last_date from bars group by 1) select distinct t.ticker, last_date, coalesce(last_date >= (select max(date) from bars) - 10, false) as still_trading from trades t left join l on l.ticker = t.ticker")
def delisting_check(spark, d):
    t = Tables(spark, d)
    return C.delisting_check(t.trades(), t.daily())


@query(f"""{_SPANS}, y as (select unnest(range(1996, 2001)) as year), x as (select year, greatest(date_diff('day', greatest(b, make_date(year, 1, 1)), least(e, make_date(year, 12, 31))), 0) as d0, case when fv is null then 0 else greatest(date_diff('day', greatest(b, make_date(year, 1, 1), fv), least(e, make_date(year, 12, 31), lv)), 0) end as c0 from s, y), mi as (select year, round((1 - sum(c0) / sum(d0)) * 100, 4) as miss from x group by 1)
select cast(year(entry_date) as integer) as year, count(*) as n, round(avg(pnl_pct), 4) as mean_pnl, round(100.0 * count(*) filter (where pnl_pct > 0) / count(*), 4) as win_rate, max(miss) as missing_pct_all from trades left join mi on mi.year = year(entry_date) group by 1""")
def yearly_edge(spark, d):
    t = Tables(spark, d).trades().groupBy(F.year("entry_date").alias("year")).agg(F.count("*").alias("n"), F.round(F.avg("pnl_pct"), 4).alias("mean_pnl"), F.round(F.count_if(F.col("pnl_pct") > 0) / F.count("*") * 100, 4).alias("win_rate"))
    return t.join(C.coverage_by_year(_spans(spark, d)).select("year", "missing_pct_all"), "year", "left")


# ------------------------------------------------------------------ inference


@query(f"""with {TRADES}, m as (select count(*) as n, avg(pnl_pct) as mu, stddev_samp(pnl_pct) as sd from trades), g as (select year(entry_date) || 'Q' || quarter(entry_date) as c, sum(pnl_pct) - any_value(mu) * count(*) as u from trades, m group by 1), s as (select count(*) as k, sum(u * u) as uu from g),
z as (select n, k, mu, sd, sd / sqrt(n) as se0, sqrt(k / (k - 1.0) * uu) / n as se1 from m, s) select n, k as n_clusters, {', '.join(f'round({e}, 4) as {a}' for a, e in (('mean', 'mu'), ('sd', 'sd'), ('t_naive', 'mu / se0'), ('t_cluster', 'mu / se1'), ('design_effect', 'se1 * se1 / (se0 * se0)')))} from z""")
def clustered_mean(spark, d):
    x = V.cluster_test(Tables(spark, d).trades(), "quarter")
    return x.select("n", "n_clusters", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "t_naive", "t_cluster", "design_effect")])


@query(f"with {TRADES}, m as (select avg(pnl_pct) as mu, count(*) as n from trades), s as (select any_value(n) as n, avg(pow(pnl_pct - mu, 2)) as m2, avg(pow(pnl_pct - mu, 3)) as m3, avg(pow(pnl_pct - mu, 4)) as m4 from trades, m) select n, round((select median(pnl_pct) from trades), 4) as median, round((select 100.0 * count(*) filter (where pnl_pct > 0) / count(*) from trades), 4) as win_rate, round(m3 / pow(m2, 1.5), 4) as skew, round(m4 / (m2 * m2) - 3, 4) as excess_kurtosis from s")
def trade_shape(spark, d):
    x = V.shape(Tables(spark, d).trades())
    return x.select("n", "median", "win_rate", F.round("skew", 4).alias("skew"), F.round("excess_kurtosis", 4).alias("excess_kurtosis"))


@query(f"with {TRADES}, x as (select abs(pnl_pct) as a, pnl_pct > 0 as p from trades where pnl_pct <> 0), k as (select a, p, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as r from x) select (select count(*) from x) as n, round(sum(r) filter (where p), 1) as rank_sum, cast((select sum(c * c * c - c) from (select count(*) as c from x group by a)) as double) as ties from k")
def signed_rank_sums(spark, d):
    x = V.signed_ranks(Tables(spark, d).trades())
    return x.select("n", F.round("rank_sum", 1).alias("rank_sum"), "ties")


_PAIRED = f"""with {EQUITY}, {REGION}, b as (select date, close from bars where ticker = 'ASIA'), p as (select cast(e.date as date) as date, portfolio_value as v, (select close from b where b.date <= e.date order by b.date desc limit 1) as c from equity e), r0 as (select date, v / lag(v) over (order by date) - 1 as y, c / lag(c) over (order by date) - 1 as x from p),
rr as (select *, row_number() over (order by date) as t from r0 where y is not null and x is not null)"""


@query(f"""{_PAIRED}, b0 as (select regr_slope(y, x) as beta, regr_intercept(y, x) as alpha, regr_r2(y, x) as r2, cast(count(*) as double) as n, sum(x) as sx, sum(x * x) as sxx, floor(4 * pow(count(*) / 100.0, 2.0 / 9)) as lags from rr), e as (select t, lags, y - alpha - beta * x as u, (y - alpha - beta * x) * x as v from rr, b0),
h as (select sum(case when p.t = o.t then p.u * o.u else 2 * (1 - (p.t - o.t) / (p.lags + 1)) * p.u * o.u end) as s00, sum(case when p.t = o.t then p.u * o.v else (1 - (p.t - o.t) / (p.lags + 1)) * (p.u * o.v + p.v * o.u) end) as s01, sum(case when p.t = o.t then p.v * o.v else 2 * (1 - (p.t - o.t) / (p.lags + 1)) * p.v * o.v end) as s11 from e p join e o on o.t <= p.t and p.t - o.t <= p.lags)
select cast(n as bigint) as n, cast(lags as bigint) as lags, round(alpha, 4) as alpha, round(beta, 4) as beta, round(r2, 4) as r2, round(sqrt((sxx * sxx * s00 - 2 * sxx * sx * s01 + sx * sx * s11) / pow(n * sxx - sx * sx, 2) * n / (n - 2)), 4) as se_alpha, round(sqrt((sx * sx * s00 - 2 * sx * n * s01 + n * n * s11) / pow(n * sxx - sx * sx, 2) * n / (n - 2)), 4) as se_beta from b0, h""")
def alpha_hac(spark, d):
    t = Tables(spark, d)
    x = V.ols_hac(V.paired_returns(t.equity().withColumn("date", F.col("date").cast("date")), t.region().where("ticker = 'ASIA'")))
    return x.select("n", "lags", *[F.round(c, 4).alias(c) for c in ("alpha", "beta", "r2", "se_alpha", "se_beta")])


def _hashed(*what: str) -> str:
    return f"cast('0x' || md5({' || chr(58) || '.join(['42'] + [f'cast({w} as varchar)' for w in what])})[1:8] as bigint)"


_BOOT = "quantile_cont({m}, 0.025) as lo, quantile_cont({m}, 0.975) as hi, avg(case when {m} <= 0 then 1.0 else 0 end) as le, avg(case when {m} >= 0 then 1.0 else 0 end) as ge"


@query(f"""with {TRADES}, g as (select strftime(entry_date, '%Y-%m') as c, count(*) as n, sum(pnl_pct) as total from trades group by 1), k as (select *, row_number() over (order by c) - 1 as k, count(*) over () as g from g),
cells as (select d, j, {_hashed('d', 'j')} % g as k from (select unnest(range(10000)) as d) a, (select distinct g from k), (select unnest(range((select max(g) from k))) as j) b), m as (select d, sum(total) / sum(n) as mean from cells join k using (k) group by 1), s as (select {_BOOT.format(m='mean')} from m)
select round(lo, 4) as ci_low, round(hi, 4) as ci_high, round(le, 4) as prob_le_0, round(least(1, 2 * least(le, ge)), 4) as p_value from s""")
def trade_bootstrap(spark, d):
    x = V.bootstrap_summary(V.cluster_bootstrap(Tables(spark, d).trades()))
    return x.select(*[F.round(c, 4).alias(c) for c in ("ci_low", "ci_high", "prob_le_0", "p_value")])


def _flat(spark, found: dict) -> DataFrame:
    """One row of all results; an interval becomes two columns."""
    row = {}
    for k, v in found.items():
        row |= {f"{k}_low": v[0], f"{k}_high": v[1]} if isinstance(v, tuple) else {k: v}
    return spark.createDataFrame([tuple(None if v is None else float(v) for v in row.values())], ", ".join(f"{k} double" for k in row))


@query()
def trade_significance(spark, d):
    """The whole result: clustered and naive tests, ranks, shape, trimmed mean, bootstrap, and what is left without the best trades."""
    return _flat(spark, V.trade_significance(Tables(spark, d).trades()))


def _curve_and_benchmark(spark, d):
    t = Tables(spark, d)
    return t.equity().withColumn("date", F.col("date").cast("date")), t.region().where("ticker = 'ASIA'")


@query(f"""{_PAIRED}, n as (select count(*) as n, greatest(2, cast(round(pow(count(*), 1.0 / 3)) as bigint)) as b from rr), cells as (select d, j, n, case when j = 0 or {_hashed("'start'", 'd', 'j')} < 4294967296 // b then j end as f, {_hashed("'place'", 'd', 'j')} % n as p from (select unnest(range(5000)) as d) x, n, (select unnest(range((select n from n))) as j) y),
st as (select d, j, n, last_value(f ignore nulls) over w as f, last_value(case when f is not null then p end ignore nulls) over w as p from cells window w as (partition by d order by j)), dr as (select d, (p + j - f) % n + 1 as t from st),
m as (select d, (pow(1 + regr_intercept(y, x), 12) - 1) * 100 as a, avg(y) / stddev_samp(y) * sqrt(12) as s from dr join rr using (t) group by 1)
select round(quantile_cont(a, 0.025), 4) as alpha_low, round(quantile_cont(a, 0.975), 4) as alpha_high, round(avg(case when a <= 0 then 1.0 else 0 end), 4) as prob_alpha_le_0, round(quantile_cont(s, 0.025), 4) as sharpe_low, round(quantile_cont(s, 0.975), 4) as sharpe_high from m""")
def alpha_bootstrap(spark, d):
    x = V.alpha_bootstrap(V.paired_returns(*_curve_and_benchmark(spark, d)))
    q_ = lambda c, p: F.round(F.percentile(c, p), 4)
    return x.agg(q_("alpha_annual", 0.025).alias("alpha_low"), q_("alpha_annual", 0.975).alias("alpha_high"), F.round(F.avg((F.col("alpha_annual") <= 0).cast("double")), 4).alias("prob_alpha_le_0"), q_("sharpe", 0.025).alias("sharpe_low"), q_("sharpe", 0.975).alias("sharpe_high"))


@query()
def portfolio_alpha_test(spark, d):
    """The whole result: alpha and beta with robust errors, Sharpe with its error, tracking, bootstraps."""
    return _flat(spark, V.alpha_test(*_curve_and_benchmark(spark, d)))


@query(f"""{_PAIRED}, m as (select avg(y) as mu, stddev_samp(y) as sd, avg(y - x) as act, stddev_samp(y - x) as te from rr), l as (select corr(y, b) as ac from (select y, lag(y) over (order by t) as b from rr)) select round(mu / sd * sqrt(12), 4) as sharpe, round(te * sqrt(12) * 100, 4) as tracking_error_pct, round(act * 12 / (te * sqrt(12)), 4) as information_ratio, round(ac, 4) as lag1 from m, l""")
def active_risk(spark, d):
    t = Tables(spark, d)
    p = V.paired_returns(t.equity().withColumn("date", F.col("date").cast("date")), t.region().where("ticker = 'ASIA'"))
    a = F.col("y") - F.col("x")
    root = F.sqrt(F.lit(12.0))
    lag1 = p.withColumn("b", F.lag("y").over(V.Window.orderBy("t"))).agg(F.round(F.corr("y", "b"), 4).alias("lag1"))
    return p.agg(F.round(F.avg("y") / F.stddev_samp("y") * root, 4).alias("sharpe"), F.round(F.stddev_samp(a) * root * 100, 4).alias("tracking_error_pct"), F.round(F.avg(a) * 12 / (F.stddev_samp(a) * root), 4).alias("information_ratio")).crossJoin(lag1)


# ------------------------------------------------------------------ benchmarks and runs

_EQUAL = f"""with {DAILY}, n0 as (select ticker, arg_min(close, date) as e from bars where date >= date '1996-01-01' group by 1), m as (select min(date) as d from bars where date between date '1996-01-01' and date '2000-12-31' group by date_trunc('month', date)),
x as (select d, n0.ticker, e, (select close from bars b where b.ticker = n0.ticker and b.date <= d order by b.date desc limit 1) as mk from m, n0), ew as (select d as date, sum(10000.0 / (select count(*) from n0) / e * coalesce(mk, e)) as portfolio_value from x group by 1)"""


def _equal(spark, d) -> DataFrame:
    bars = Tables(spark, d).daily()
    return D.equal_weight(bars, bars.select("ticker"), T.review_dates(bars.select("date").distinct(), "1996-01-01", "2000-12-31"), "1996-01-01")


@query(f"{_EQUAL} select date, round(portfolio_value, 2) as portfolio_value from ew")
def equal_weight_marks(spark, d):
    return _equal(spark, d).withColumn("portfolio_value", F.round("portfolio_value", 2))


@query(f"{_EQUAL}, g as (select round((arg_max(portfolio_value, date) / arg_min(portfolio_value, date) - 1) * 100, 2) as ew from ew) select 30.0 - ew as picking_gap, ew - 12.0 as exposure_gap, case when (ew - 12.0) / 18.0 * 100 between 0 and 100 then round((ew - 12.0) / 18.0 * 100, 4) end as pct_from_exposure from g")
def exposure_attribution(spark, d):
    x = M.equity_stats(_equal(spark, d))
    own = D.exposure_attribution(F.lit(30.0), F.col("total_return"), F.lit(12.0))
    return x.select(own["picking_gap"].alias("picking_gap"), own["exposure_gap"].alias("exposure_gap"), F.round(own["pct_from_exposure"], 4).alias("pct_from_exposure"))


_GRID = f"with {TRADES}, g as (select cast(s as double) as stop, cast(t as double) as target, avg(case when pnl_pct <= -s then -s when pnl_pct >= t then t else pnl_pct end) as v from trades, (select unnest([1.0, 2.0, 3.0, 4.0]) as s) a, (select unnest([2.0, 4.0, 6.0]) as t) b group by 1, 2)"


def _grid(spark, d) -> DataFrame:
    p = F.col("pnl_pct")
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("stop"), F.lit(t).alias("target")) for s in (1.0, 2.0, 3.0, 4.0) for t in (2.0, 4.0, 6.0)]))
    x = Tables(spark, d).trades().groupBy("pnl_pct").agg(F.count("*").alias("c")).withColumn("g", cells).select("pnl_pct", "c", "g.*")
    v = F.when(p <= -F.col("stop"), -F.col("stop")).when(p >= F.col("target"), F.col("target")).otherwise(p)
    return x.groupBy("stop", "target").agg((F.sum(v * F.col("c")) / F.sum("c")).alias("v"))


@query(f"{_GRID}, h as (select v from g where stop = 2 and target = 4), nb as (select v from g where abs(stop - 2) <= 1 and abs(target - 4) <= 2 and not (stop = 2 and target = 4)) select round((select v from h), 6) as current_value, round((select max(v) from g), 6) as grid_best_value, (select count(*) from nb) as n_neighbors, round((select avg(v) from nb), 6) as neighbor_mean, round((select stddev_samp(v) from nb), 6) as neighbor_std")
def grid_stability(spark, d):
    x = D.local_stability(_grid(spark, d), "stop", "target", "v", 2.0, 4.0)
    return x.select(*[F.round(c, 6).alias(c) for c in ("current_value", "grid_best_value", "neighbor_mean", "neighbor_std")], "n_neighbors")


@query(f"{_GRID} select 'v' as metric, round(avg(v), 3) as mean, round(stddev_samp(v), 3) as std, round(min(v), 3) as min, round(max(v), 3) as max, round(max(v) - min(v), 3) as range from g")
def grid_noise(spark, d):
    return M.noise(_grid(spark, d), ["v"], 3)


def _world(spark, d, members=None, t=None):
    t = t or Tables(spark, d)
    bars = t.daily()
    sectors = t.bars("daily", K.daily(t.q), "sector").select("ticker", "sector").distinct()
    regimes = {n: B.Regime(k, s, 1.5, 4.0, h, c) for n, k, s, h, c in (("bull", 5, 5.0, 365, 0.0), ("neutral", 4, 5.5, 200, 0.1), ("bear", 2, 6.5, 90, 0.3))}
    return B.panel(bars, min_avg_volume=0.0), B.world(bars, members, sectors, t.components(), regimes), bars


_BASE = B.Config(start="1996-06-01", end="1998-05-31", signal_threshold=5.0, exit_score_threshold=3.0, top_n=4)


@query()
def walk_forward(spark, d):
    """The daily bars: the base run, with sectors and correlation limits, sized by risk, under regimes, weekly."""
    panel, world, _ = _world(spark, d)
    from dataclasses import replace

    runs = [_BASE, replace(_BASE, name="limits", use_sectors=True, max_per_sector=1, max_pairwise_correlation=0.05), replace(_BASE, name="risk", sizing_method="atr_risk_based", realistic_stop_fills=True), replace(_BASE, name="regime", use_regime=True, use_dispersion_sizing=True), replace(_BASE, name="weekly", review_frequency="weekly")]
    return B.summary(B.run(panel, runs, world), runs)


@query()
def monte_carlo_runs(spark, d):
    """Bootstrapped and shuffled orders of the base run's trades, with the rank of what happened."""
    panel, world, _ = _world(spark, d)
    results = B.run(panel, [_BASE], world)
    known = B.summary(results, [_BASE]).first()
    values = monte_carlo.tally(B.trades(results))
    out = None
    for method in ("bootstrap", "shuffle"):
        paths = monte_carlo.simulate(None, method=method, values=values)
        x = D.monte_carlo_summary(paths, known["total_return"], known["max_drawdown"]).withColumn("method", F.lit(method))
        out = x if out is None else out.unionByName(x)
    return out.withColumn("verdict", D.luck_verdict(F.col("known_return_percentile")))


@query()
def parameter_sweep(spark, d):
    panel, world, _ = _world(spark, d)
    runs = B.grid(_BASE, {"atr_trail_mult": (1.5, 2.5, 3.5), "trail_trigger_atr": (0.5, 1.0)})
    return B.summary(B.run(panel, runs, world), runs)


@query()
def cost_stress_runs(spark, d):
    panel, world, _ = _world(spark, d)
    runs = B.cost_stress(_BASE)
    return B.summary(B.run(panel, runs, world), runs)


@query()
def window_runs(spark, d):
    panel, world, _ = _world(spark, d)
    from dataclasses import replace

    runs = B.windows([_BASE, replace(_BASE, name="tight", hard_floor_atr=2.0)], [("1996-06-01", "1997-05-31"), ("1996-12-01", "1998-05-31"), ("2031-01-01", "2031-12-31")])
    return B.summary(B.run(panel, runs, world), runs)


def _arms(t):
    k = F.regexp_extract("ticker", "[0-9]+", 0).cast("int")
    m = t.daily().select("ticker").distinct().select("ticker", F.lit("1995-01-01").cast("date").alias("date_added"), F.when(k % 3 == 0, F.lit("1997-03-31").cast("date")).alias("date_removed"))
    return {n: x for n, x in C.variants(m, "1998-03-01").items() if x is not None} | {f"placebo{i}": m.join(C.universe_sample(m, 8, i), "ticker", "left_semi") for i in range(4)}


@query()
def survivorship_arms(spark, d):
    t = Tables(spark, d)  # arms and runs share its bars
    panel, world, _ = _world(spark, d, _arms(t), t)
    runs = B.arms(_BASE, ["pit", "survivors_true_dates", "current_list_naive", None])
    results = B.run(panel, runs, world)
    return B.compare(results, B.summary(results, runs), "pit")


@query()
def placebo_universes(spark, d):
    t = Tables(spark, d)  # arms and runs share its bars
    panel, world, _ = _world(spark, d, _arms(t), t)
    runs = B.arms(_BASE, ["pit", "survivors_true_dates", *(f"placebo{i}" for i in range(4))])
    s = B.summary(B.run(panel, runs, world), runs)
    rows = {r["config"]: r.asDict() for r in s.where("config in ('pit', 'survivors_true_dates')").collect()}
    return V.placebo_verdict(rows["pit"], rows["survivors_true_dates"], s.where("config like 'placebo%'"))


@query()
def tiebreak_noise(spark, d):
    panel, world, _ = _world(spark, d)
    runs = B.tiebreaks(_BASE, 6)
    return M.noise(B.summary(B.run(panel, runs, world), runs), ["total_return", "sharpe_ratio", "max_drawdown", "expectancy_pct"])


@query()
def regime_ablation(spark, d):
    panel, world, _ = _world(spark, d)
    from dataclasses import replace

    runs = [replace(_BASE, name="ablated", use_regime=True)]
    return B.summary(B.run(panel, runs, B.ablation(world, "bear", top_n=4, cash_pct=0.0)), runs)
