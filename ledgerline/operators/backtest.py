"""Walk-forward runs: many configurations over one panel of point-in-time scores.

Indicators and scores are one window pass over the bars. What is left is a fold over
review dates whose state is a handful of positions and the cash; it runs once for each
configuration, in a task of its own, over the bars of the tickers that were ever
eligible. Sweeps, stress tests, rolling windows, ablations, placebo universes and
tie-break noise are lists of configurations.

At each review: exits since the last one (stops, targets, longest hold, delisting),
then positions whose score has gone, then entries by score under sector and correlation
limits at the day's open, then the mark. What is open at the end is closed at the last
close.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import date as Date
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import values as V
from . import metrics
from .keep import kept
from .scan import point_in_time

SUBSCORES = ("s_rsi", "s_bb", "s_mr", "s_stochrsi", "s_williams")
RESULT = (
    "config string, kind string, ticker string, entry_date date, exit_date date, entry_price double, exit_price double, shares double, pnl double, pnl_pct double, exit_reason string, signal_score double, hold_days int, "
    "regime string, dispersion_bucket string, size_mult double, date date, portfolio_value double, value_with_costs double, value_without_costs double, n_positions int, n_new int, pct_invested double, capital double, costs double, error string"
)
TRADE = ("ticker", "entry_date", "exit_date", "entry_price", "exit_price", "shares", "pnl", "pnl_pct", "exit_reason", "signal_score", "hold_days", "regime", "dispersion_bucket", "size_mult")


@dataclass(frozen=True)
class Config:
    """One run. Names in ``membership`` and ``regimes`` point to tables that are given with the panel."""

    name: str = "base"
    start: str = "1900-01-01"
    end: str = "2999-12-31"
    initial_capital: float = 10_000.0
    top_n: int = 5
    signal_threshold: float = 6.5
    max_hold_days: int = 365
    review_frequency: str = "monthly"
    warm_up: int = 252
    stop_atr_mult: float = 1.5  # only sizes positions by risk
    target_atr_mult: float = 4.0
    atr_trail_mult: float = 2.5
    guard_days: int = 15
    hard_floor_atr: float = 3.0
    trail_trigger_atr: float = 1.0
    cash_pct: float = 0.0
    exit_score_threshold: float = 5.0
    rolling_atr: bool = True
    bear_regime_exit: bool = True
    use_regime: bool = False
    use_dispersion_sizing: bool = False
    dispersion_size_mult: Mapping[str, float] = field(default_factory=lambda: {"broad": 1.0, "neutral": 1.0, "narrow": 0.7})
    weights: Mapping[str, float] = field(default_factory=lambda: dict(V.WEIGHTS))
    membership: str | None = None
    use_sectors: bool = False
    max_per_sector: int = 3
    max_pairwise_correlation: float | None = None
    correlation_lookback_days: int = 60
    correlation_min_obs: int = 20
    sizing_method: str = "fixed_fractional"
    risk_per_trade_pct: float = 0.01
    max_pct_per_position: float = 0.20
    liquidity_pct_adv: float = 0.01
    slippage_pct: float = 0.0005
    next_open_entry: bool = True
    realistic_stop_fills: bool = False
    apply_transaction_costs: bool = True
    commission_per_share: float = 0.005
    commission_min: float = 1.0
    commission_max_pct: float = 0.01
    tiebreak_seed: int | None = None

    def __post_init__(self) -> None:
        if self.sizing_method not in ("fixed_fractional", "atr_risk_based"):
            raise ValueError(f"no such sizing: {self.sizing_method}")
        if self.review_frequency not in ("monthly", "weekly"):
            raise ValueError(f"no such frequency: {self.review_frequency}")


def check_locked(config: Config, locked: Mapping[str, object]) -> None:
    """Raises where a value differs from its locked one, or the weights do not sum to 1."""
    wrong = {k: getattr(config, k) for k, v in locked.items() if getattr(config, k) != v}
    if wrong or abs(sum(config.weights.values()) - 1) > 1e-9:
        raise ValueError(f"not as locked: {wrong or 'weights'}")


@dataclass(frozen=True)
class Regime:
    """What a regime sets in place of the configuration's values."""

    top_n: int
    signal_threshold: float
    stop_atr_mult: float
    target_atr_mult: float
    max_hold_days: int
    cash_pct: float


@dataclass(frozen=True)
class World:
    """Tables as small as days, tickers and intervals, which every run reads."""

    days: tuple[int, ...]
    members: Mapping[str, Mapping[str, list[tuple[int, int]]]]
    sectors: Mapping[str, str]
    labels: tuple[tuple[int, str, str | None], ...]  # day, regime, dispersion signal
    regimes: Mapping[str, Regime]


class Series:
    """The bars of a ticker; scores are NaN where a gate is closed."""

    def __init__(self, g: pd.DataFrame, weights: Mapping[str, float]):
        own = S.no_pcr_weights(weights)
        self.day = g["day"].tolist()
        self.open, self.high, self.low, self.close = (g[c].to_numpy(float) for c in ("open", "high", "low", "close"))
        self.score = np.round(sum(g[c].to_numpy(float) * own[c] for c in SUBSCORES), 2)
        self.atr, self.volume = np.round(g["atr"].to_numpy(float), 2), np.round(g["avg_volume"].to_numpy(float))

    def at(self, day: int) -> int:
        """Place of the last bar on or before the day; -1 if there is none."""
        return bisect_right(self.day, day) - 1

    def returns(self, day: int, n: int) -> dict[int, float] | None:
        k = self.at(day)
        if k < n:
            return None
        c = self.close[k - n : k + 1]
        return dict(zip(self.day[k - n + 1 : k + 1], (c[1:] / c[:-1] - 1).tolist()))


@dataclass
class Position:
    ticker: str
    shares: float
    entry: float
    day: int
    atr: float
    target: float
    peak: float
    max_hold: int
    score: float
    regime: str
    bucket: str
    mult: float
    sector: str


def correlation(a: Mapping[int, float], b: Mapping[int, float], least: int) -> float | None:
    both = [d for d in a if d in b]
    if len(both) < least:
        return None
    x, y = (np.array([s[d] for d in both]) for s in (a, b))
    return float(np.corrcoef(x, y)[0, 1]) if x.std() > 0 and y.std() > 0 else None


def first_exit(p: Position, s: Series, after: int, until: int, c: Config) -> tuple[str, float, int] | None:
    """Reason, price and day of the first exit in (after, until]; keeps the peak."""
    for k in range(s.at(after) + 1, s.at(until) + 1):
        held = s.day[k] - p.day
        p.peak = max(p.peak, s.high[k])
        atr = p.atr or 0.02 * p.entry
        if held < c.guard_days:
            phase, stop = "guard", p.entry - c.hard_floor_atr * atr
        elif p.peak >= p.entry + c.trail_trigger_atr * atr:
            phase, stop = "trail", max(p.peak - c.atr_trail_mult * atr, p.entry)
        else:
            phase, stop = "breakeven", p.entry
        if s.low[k] <= stop:
            return f"stop_{phase}", round(min(stop, s.open[k]) if c.realistic_stop_fills else stop, 2), s.day[k]
        if s.high[k] >= p.target:
            return "target_2", p.target, s.day[k]
        if held >= p.max_hold:
            return "max_hold", float(s.close[k]), s.day[k]
    return None


class Run:
    """The fold of one configuration."""

    def __init__(self, config: Config, bars: Mapping[str, Series], world: World):
        self.c, self.bars, self.world = config, bars, world
        self.cash, self.costs = config.initial_capital, 0.0
        self.book: dict[str, Position] = {}
        self.rows: list[dict] = []

    def fee(self, shares: float, price: float) -> None:
        c, n = self.c, abs(shares)
        fee = min(max(n * c.commission_per_share, c.commission_min), n * price * c.commission_max_pct)
        self.costs += fee
        if c.apply_transaction_costs:
            self.cash -= fee

    def close(self, ticker: str, reason: str, quoted: float, day: int) -> None:
        p = self.book.pop(ticker)
        price = quoted * (1 - self.c.slippage_pct)
        self.cash += p.shares * price
        self.fee(p.shares, price)
        self.rows.append({
            "kind": "trade", "ticker": ticker, "entry_date": p.day, "exit_date": day, "entry_price": p.entry, "exit_price": price, "shares": p.shares, "pnl": round((price - p.entry) * p.shares, 2), "pnl_pct": round((price - p.entry) / p.entry * 100, 2),
            "exit_reason": reason, "signal_score": p.score, "hold_days": day - p.day, "regime": p.regime, "dispersion_bucket": p.bucket, "size_mult": p.mult,
        })

    def label(self, day: int) -> tuple[str, str]:
        """Regime and dispersion bucket as of the day."""
        k = bisect_right(self.world.labels, (day, "￿", "")) - 1
        if not self.c.use_regime or k < 0:
            return "fixed", "n/a"
        signal = next((s for _, _, s in reversed(self.world.labels[: k + 1]) if s), None)
        return self.world.labels[k][1], {"bull": "broad", "neutral": "neutral", "bear": "narrow"}.get(signal, "n/a")

    def stops(self, after: int, review: int) -> None:
        leaving = []
        for t, p in self.book.items():
            s = self.bars[t]
            last = s.day[-1]
            if last < after:
                leaving.append((t, "delisted", float(s.close[-1]), last))
            elif hit := first_exit(p, s, after, review, self.c):
                leaving.append((t, hit[0], hit[1], hit[2]))
            elif after < last <= review:
                leaving.append((t, "delisted", float(s.close[-1]), last))
        for t, reason, price, day in leaving:
            self.close(t, reason, price, day)

    def deteriorated(self, review: int, bear: bool) -> None:
        leaving = []
        for t, p in self.book.items():
            s = self.bars[t]
            k = s.at(review)
            if bear:
                leaving.append((t, "bear_regime_exit", float(s.close[k]) if k >= 0 else p.entry))
            elif k >= 0 and not math.isnan(s.score[k]):
                if s.score[k] < self.c.exit_score_threshold:
                    leaving.append((t, "score_deterioration", float(s.close[k])))
                elif self.c.rolling_atr and s.atr[k] > 0:
                    p.atr = float(s.atr[k])
        for t, reason, price in leaving:
            self.close(t, reason, price, review)

    def candidates(self, review: int, threshold: float) -> list[tuple[str, int]]:
        """Tickers that may be bought with the place of the bar that scores them, best first."""
        members = self.world.members.get(self.c.membership) if self.c.membership else None
        names = sorted(self.bars)
        if members is not None:
            names = [t for t in names if any(a <= review <= b for a, b in members.get(t, ()))]
        if self.c.tiebreak_seed is not None:
            names.sort(key=lambda t: hashlib.blake2b(f"{self.c.tiebreak_seed}:{review}:{t}".encode()).digest())
        found = []
        for t in names:
            s = self.bars[t]
            k = bisect_left(s.day, review) - 1 if self.c.next_open_entry else s.at(review)
            if t not in self.book and k >= 0 and s.score[k] >= threshold:
                found.append((t, k))
        return sorted(found, key=lambda x: -self.bars[x[0]].score[x[1]])

    def chosen(self, found: list[tuple[str, int]], slots: int, review: int) -> list[tuple[str, int]]:
        """The first that fit the limits of sectors and correlation, held positions counted."""
        c, out = self.c, []
        per_sector: dict[str, int] = {}
        for p in self.book.values():
            per_sector[p.sector] = per_sector.get(p.sector, 0) + 1
        beside = [self.bars[t].returns(review, c.correlation_lookback_days) for t in self.book] if c.max_pairwise_correlation is not None else []
        for t, k in found:
            if len(out) >= slots:
                break
            sector = self.world.sectors.get(t, "Unknown")
            if c.use_sectors and per_sector.get(sector, 0) >= c.max_per_sector:
                continue
            if c.max_pairwise_correlation is not None:
                own = self.bars[t].returns(review, c.correlation_lookback_days)
                against = [correlation(own, r, c.correlation_min_obs) for r in beside if r is not None] if own is not None else []
                if any(r is not None and abs(r) > c.max_pairwise_correlation for r in against):
                    continue
                beside.append(own)
            out.append((t, k))
            per_sector[sector] = per_sector.get(sector, 0) + 1
        return out

    def enter(self, review: int, set_: Regime, regime: str, bucket: str) -> int:
        c, opened = self.c, 0
        slots, free = set_.top_n - len(self.book), self.cash * (1 - set_.cash_pct)
        if slots <= 0 or free <= 100:
            return 0
        mult = c.dispersion_size_mult.get(bucket, 1.0) if c.use_regime and c.use_dispersion_sizing else 1.0
        for t, k in self.chosen(self.candidates(review, set_.signal_threshold), slots, review):
            s = self.bars[t]
            if c.next_open_entry:
                today = s.at(review)
                if s.day[today] != review:
                    continue  # no bar that day: the slot stays empty
                quoted = float(s.open[today])
            else:
                quoted = round(float(s.close[k]), 2)
            if not quoted > 0:
                continue
            price, atr = quoted * (1 + c.slippage_pct), float(s.atr[k])
            if c.sizing_method == "atr_risk_based":
                if set_.stop_atr_mult * atr <= 0:
                    continue
                by_volume = c.liquidity_pct_adv * s.volume[k] if s.volume[k] else math.inf
                shares = min(self.cash * c.risk_per_trade_pct / (set_.stop_atr_mult * atr), c.max_pct_per_position * self.cash / price, by_volume) * mult
                shares = min(shares, free / price) if free > 0 else 0.0
            else:
                shares = min(free / set_.top_n, self.cash * (1 - set_.cash_pct)) * mult / price
            if shares <= 0:
                continue
            self.cash -= shares * price
            self.fee(shares, price)
            opened += 1
            self.book[t] = Position(t, shares, price, review, atr, round(price + set_.target_atr_mult * atr, 2), price, set_.max_hold_days, float(s.score[k]), regime, bucket if c.use_dispersion_sizing else "n/a", mult, self.world.sectors.get(t, "Unknown") if c.use_sectors else "Unknown")
        return opened

    def mark(self, review: int, opened: int) -> None:
        def price(p: Position) -> float:
            s = self.bars[p.ticker]
            k = s.at(review)
            return float(s.close[k]) if k >= 0 else p.entry

        value = self.cash + sum(p.shares * price(p) for p in self.book.values())
        with_, without = (value, value + self.costs) if self.c.apply_transaction_costs else (value - self.costs, value)
        self.rows.append({"kind": "equity", "date": review, "portfolio_value": value, "value_with_costs": with_, "value_without_costs": without, "n_positions": len(self.book), "n_new": opened, "pct_invested": round((value - self.cash) / value * 100, 1) if value > 0 else 0.0})

    def reviews(self) -> list[int]:
        """First trading day inside the range of each month or week, with enough trading days before."""
        lo, hi = (ordinal(Date.fromisoformat(x)) for x in (self.c.start, self.c.end))
        out, seen = [], None
        for n, day in enumerate(self.world.days):
            if lo <= day <= hi:
                d = Date(1970, 1, 1) + timedelta(day)
                key = (d.year, d.month) if self.c.review_frequency == "monthly" else d.isocalendar()[:2]
                if key != seen:
                    seen = key
                    if n >= self.c.warm_up:
                        out.append(day)
        return out

    def go(self) -> list[dict]:
        c = self.c
        own = Regime(c.top_n, c.signal_threshold, c.stop_atr_mult, c.target_atr_mult, c.max_hold_days, c.cash_pct)
        last = ordinal(Date.fromisoformat(c.start))
        for review in self.reviews():
            regime, bucket = self.label(review)
            set_ = self.world.regimes.get(regime, own) if c.use_regime else own
            self.stops(last, review)
            self.deteriorated(review, c.use_regime and c.bear_regime_exit and regime == "bear")
            opened = self.enter(review, set_, regime, bucket)
            self.mark(review, opened)
            last = review
        days = [d for d in self.world.days if d <= ordinal(Date.fromisoformat(c.end))] or list(self.world.days[-1:])
        for t in list(self.book):
            s = self.bars[t]
            self.close(t, "end_of_backtest", float(s.close[s.at(days[-1])]), days[-1])
        self.rows.append({"kind": "end", "capital": self.cash, "costs": self.costs})
        return self.rows


def ordinal(d: Date) -> int:
    return (d - Date(1970, 1, 1)).days


def panel(bars: DataFrame, rsi_max: float = 50.0, min_avg_volume: float = 500_000.0, **params) -> DataFrame:
    """Complete bars of the tickers that were ever eligible, with sub-scores, atr and avg_volume where every gate is open."""
    whole = bars.na.drop(subset=["open", "high", "low", "close", "volume"])
    open_ = point_in_time(whole, rsi_max=rsi_max, min_avg_volume=min_avg_volume, **params).select("ticker", "date", *SUBSCORES, "atr", "avg_volume")
    own = whole.join(open_.select("ticker").distinct(), "ticker", "left_semi")
    return own.join(open_, ["ticker", "date"], "left").select("ticker", F.unix_date("date").alias("day"), "open", "high", "low", "close", *SUBSCORES, "atr", "avg_volume")


def world(bars: DataFrame, members: Mapping[str, DataFrame] | None = None, sectors: DataFrame | None = None, components: DataFrame | None = None, regimes: Mapping[str, Regime] | None = None) -> World:
    """Reads the small tables: trading days, intervals, sectors, daily labels."""
    days = tuple(sorted(r[0] for r in bars.select(F.unix_date("date")).distinct().collect()))
    spans: dict[str, dict[str, list[tuple[int, int]]]] = {}
    for name, table in (members or {}).items():
        own = spans.setdefault(name, {})
        for t, a, b in table.select("ticker", F.unix_date("date_added"), F.coalesce(F.unix_date("date_removed"), F.lit(1 << 30))).collect():
            own.setdefault(t, []).append((a, b))
    names = {} if sectors is None else {t: s or "Unknown" for t, s in sectors.select("ticker", "sector").collect()}
    labels = () if components is None else tuple(sorted((a, b, c or "") for a, b, c in components.select(F.unix_date("date"), "regime", "dispersion_signal").collect()))
    return World(days, spans, names, labels, dict(regimes or {}))


def run(panel: DataFrame, configs: Sequence[Config], world: World) -> DataFrame:
    """Trades, equity marks and ends of every configuration (``kind``). A run that fails leaves a row with its error."""
    by_name = {c.name: c for c in configs}
    if len(by_name) < len(configs):
        raise ValueError("names of configurations must differ")
    columns = [f.split()[0] for f in RESULT.split(", ")]

    def fold(key: tuple[str], frame: pd.DataFrame) -> pd.DataFrame:
        config = by_name[key[0]]
        try:
            bars = {t: Series(g, config.weights) for t, g in frame.sort_values(["ticker", "day"]).groupby("ticker")}
            rows = Run(config, bars, world).go()
        except Exception as e:  # the other runs go on
            rows = [{"kind": "error", "error": f"{type(e).__name__}: {e}"}]
        out = pd.DataFrame(rows, columns=columns).assign(config=config.name)
        for c in ("entry_date", "exit_date", "date"):
            out[c] = [None if pd.isna(d) else Date(1970, 1, 1) + timedelta(int(d)) for d in out[c]]
        return out.astype({c: object for c in ("ticker", "exit_reason", "regime", "dispersion_bucket", "error")})

    names = panel.sparkSession.createDataFrame([(n,) for n in by_name], "config string")
    return kept(panel.crossJoin(F.broadcast(names)).groupBy("config").applyInPandas(fold, RESULT), "runs")  # every run reads the panel; a summary reads the runs several times


def trades(results: DataFrame) -> DataFrame:
    return results.where("kind = 'trade'").select("config", *TRADE)


def equity(results: DataFrame) -> DataFrame:
    return results.where("kind = 'equity'").select("config", "date", "portfolio_value", "value_with_costs", "value_without_costs", "n_positions", "n_new", "pct_invested")


def summary(results: DataFrame, configs: Sequence[Config]) -> DataFrame:
    """All metrics of each configuration; null, with the error, for one that failed."""
    start = results.sparkSession.createDataFrame([(c.name, c.initial_capital) for c in configs], "config string, initial double")
    ends = start.join(results.where("kind in ('end', 'error')").select("config", "capital", "costs", "error"), "config", "left")
    curve = equity(results).join(ends, "config")
    a = metrics.trade_stats(trades(results), ["config"])
    b = metrics.equity_stats(curve.select("config", "date", "portfolio_value"), by=["config"])
    x = ends.join(a, "config", "left").join(b.drop("total_return", "annual_return", "calmar_ratio"), "config", "left")
    dates = equity(results).groupBy("config").agg(F.min("date").alias("d0"), F.max("date").alias("d1"))
    growth, years = F.col("capital") / F.col("initial"), F.datediff("d1", "d0") / 365.25
    annual = F.round(F.when((years > 0) & (growth > 0), (F.pow(growth, 1 / years) - 1) * 100).otherwise(0.0), 2)
    x = x.join(dates, "config", "left").withColumns({"total_return": F.round((growth - 1) * 100, 2), "annual_return": annual})
    return x.withColumn("calmar_ratio", F.when(F.col("max_drawdown") != 0, F.round(F.col("annual_return") / F.abs("max_drawdown"), 2)).otherwise(0.0)).drop("d0", "d1")


def grid(base: Config, axes: Mapping[str, Iterable]) -> list[Config]:
    """Every combination of the values of the axes."""
    out = []
    for combo in itertools.product(*axes.values()):
        own = dict(zip(axes, combo))
        out.append(replace(base, name=",".join(f"{k}={v}" for k, v in own.items()), **own))
    return out


def cost_stress(base: Config, multipliers: Sequence[int] = (1, 2, 3)) -> list[Config]:
    """Slippage and the fee by share times so much; the fee's bounds stay."""
    return [replace(base, name=f"{m}x", slippage_pct=round(base.slippage_pct * m, 6), commission_per_share=round(base.commission_per_share * m, 6)) for m in multipliers]


def windows(bases: Sequence[Config], spans: Iterable[tuple[str, str]]) -> list[Config]:
    """Every configuration over every window."""
    return [replace(c, name=f"{c.name}|{a}|{b}", start=a, end=b) for c in bases for a, b in spans]


def arms(base: Config, names: Sequence[str | None]) -> list[Config]:
    """Only the candidate universe differs."""
    return [replace(base, name=n or "no_membership", membership=n) for n in names]


def tiebreaks(base: Config, n: int = 10) -> list[Config]:
    """Only the order of equal scores differs."""
    return [replace(base, name=f"tiebreak{k}", tiebreak_seed=k) for k in range(1, n + 1)]


def ablation(base: World, regime: str, **changes) -> World:
    """The same tables with some values of a regime changed."""
    return replace(base, regimes={**base.regimes, regime: replace(base.regimes[regime], **changes)})


def compare(results: DataFrame, summaries: DataFrame, baseline: str) -> DataFrame:
    """Each run beside the baseline: differences, and the overlap of its (ticker, entry_date) with the baseline's in percent."""
    keys = trades(results).select("config", "ticker", "entry_date").distinct()
    base = keys.where(F.col("config") == baseline).select("ticker", "entry_date").withColumn("in_base", F.lit(True))
    sizes = keys.join(base, ["ticker", "entry_date"], "left").groupBy("config").agg(F.count("*").alias("n"), F.count("in_base").alias("both"))
    b = summaries.where(F.col("config") == baseline).select(*[F.col(c).alias(f"b_{c}") for c in ("annual_return", "sharpe_ratio", "max_drawdown", "expectancy_pct")])
    x = summaries.join(sizes, "config", "left").crossJoin(F.broadcast(b)).crossJoin(F.broadcast(base.agg(F.count("*").alias("nb"))))  # one row each
    overlap = F.col("both") / (F.col("n") + F.col("nb") - F.col("both")) * 100
    return x.select("config", "n_trades", "total_return", "annual_return", "sharpe_ratio", "max_drawdown", "expectancy_pct", F.round(overlap, 4).alias("trade_overlap_pct"), *[F.round(F.col(c) - F.col(f"b_{c}"), 4).alias(f"delta_{c}") for c in ("annual_return", "sharpe_ratio", "max_drawdown", "expectancy_pct")])


def cost_verdict(first_return: Column, worst_return: Column, first_sharpe: Column, worst_sharpe: Column) -> Column:
    return F.when(worst_return <= 0, "edge does not survive").when(worst_sharpe < 0.5 * first_sharpe, "cost sensitive").when(first_return.isNotNull(), "edge holds")


def described(config: Config) -> dict:
    return asdict(config)
