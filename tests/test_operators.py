"""The operators against plain Python on seeded walks."""

import datetime
import itertools
import math
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline import sources, streaming
from ledgerline.functions import finance, tails
from ledgerline.functions import scores as S
from ledgerline.functions import values as VALUES
from ledgerline.operators import backtest as B
from ledgerline.operators import diagnostics as D
from ledgerline.operators import exits as X
from ledgerline.operators import indicators as I
from ledgerline.operators import inference as V
from ledgerline.operators import ledger as L
from ledgerline.operators import monte_carlo
from ledgerline.operators import scan as SC
from ledgerline.operators import timeline as T


@pytest.fixture(scope="module")
def bars(spark):
    return sources.random_walk(spark, 6, 520, 3).cache()


@pytest.fixture(scope="module")
def walks(bars):
    return {t: g.sort_values("date").reset_index(drop=True) for t, g in bars.toPandas().groupby("ticker")}


def close(a, b, tolerance=1e-6):
    return (a is None or math.isnan(a)) and (b is None or math.isnan(b)) or math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)


def plain(g):
    """Every indicator, with another library's rolling and exponential means."""
    c, h, l, v = g["close"], g["high"], g["low"], g["volume"]
    d = c.diff()
    up, down = (x.ewm(com=13, min_periods=14, adjust=True).mean() for x in (d.clip(lower=0), (-d).clip(lower=0)))
    out = pd.DataFrame({"rsi": (100 - 100 / (1 + up / down.replace(0, np.nan))).fillna(50.0)})
    tr = pd.concat([h - l, (h - c.shift()).abs(), (l - c.shift()).abs()], axis=1).max(axis=1)
    out["atr"] = tr.ewm(span=14, adjust=False, min_periods=14).mean()
    mean, sd = c.rolling(20).mean(), c.rolling(20).std()
    out["pct_b"] = (c - (mean - 2 * sd)) / (4 * sd)
    out["z_score"] = (c - c.rolling(252, min_periods=1).mean()) / c.rolling(252, min_periods=1).std()
    lo, hi = out["rsi"].rolling(14).min(), out["rsi"].rolling(14).max()
    out["stoch_k"] = ((out["rsi"] - lo) / (hi - lo).replace(0, np.nan)).rolling(3).mean()
    out["stoch_d"] = out["stoch_k"].rolling(3).mean()
    out["williams_r"] = -100 * (h.rolling(14).max() - c) / (h.rolling(14).max() - l.rolling(14).min())
    out["avg_volume"] = v.rolling(20).mean()
    out["atr_percentile"] = [np.nan if np.isnan(a) else 100 * (out["atr"].iloc[max(0, i - 251) : i + 1] <= a).sum() / out["atr"].iloc[max(0, i - 251) : i + 1].count() for i, a in enumerate(out["atr"])]
    return out


def band(x, table, op, beyond, missing):
    if x is None or math.isnan(x):
        return missing
    return next((s for t, s in table if (x <= t if op == "<=" else x < t)), beyond)


def plain_scores(p):
    return {
        "s_rsi": band(p["rsi"], VALUES.RSI_SCORES, "<=", 0, 0), "s_bb": band(p["pct_b"], VALUES.BOLLINGER_SCORES, "<", 1, 5), "s_mr": band(p["z_score"], VALUES.ZSCORE_SCORES, "<", 1, 5),
        "s_stochrsi": band(p["stoch_k"], VALUES.STOCHASTIC_SCORES, "<=", 0.5, 5), "s_williams": band(p["williams_r"], VALUES.WILLIAMS_SCORES, "<=", 0.5, 5),
    }


@pytest.fixture(scope="module")
def plains(walks):
    return {t: plain(g) for t, g in walks.items()}


def test_indicators(bars, walks, plains):
    got = {(r.ticker, r.i): r for r in I.subscores(I.indicators(bars, True)).collect()}
    for t, p in plains.items():
        for i in range(len(p)):
            r = got[t, i]
            for name in p.columns:
                assert close(r[name], p[name].iloc[i], 1e-7), (t, i, name)
            if i > 40:
                for name, want in plain_scores(p.iloc[i]).items():
                    assert r[name] == want, (t, i, name)
    assert got[min(plains), 0].rsi == 50.0


def test_exponential_means_do_not_overflow(spark):
    long = spark.range(12_000).select(F.lit("a").alias("ticker"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (100 + F.sin(F.col("id"))).alias("close")).withColumns({c: F.col("close") for c in ("open", "high", "low")} | {"volume": F.lit(1.0)})
    p = long.orderBy("date").toPandas()
    for period in (3, 14, 100):
        got = I.atr(I.rsi(I.numbered(long), period), period).orderBy("i").toPandas()
        d = p["close"].diff()
        up, down = (x.ewm(com=period - 1, min_periods=period, adjust=True).mean() for x in (d.clip(lower=0), (-d).clip(lower=0)))
        assert np.allclose(got["rsi"], (100 - 100 / (1 + up / down)).fillna(50), atol=1e-8)


def plain_exit(g, at, entry, atr, target, max_hold, c, fills=False):
    peak = entry
    for k in range(at + 1, len(g)):
        r, held = g.iloc[k], (g.date[k] - g.date[at]).days
        peak = max(peak, r.high)
        if held < c.guard_days:
            phase, stop = "guard", entry - c.hard_floor_atr * atr
        elif peak >= entry + c.trail_trigger_atr * atr:
            phase, stop = "trail", max(peak - c.atr_trail_mult * atr, entry)
        else:
            phase, stop = "breakeven", entry
        if r.low <= stop:
            return f"stop_{phase}", r.open if fills and r.open < stop else stop, g.date[k]
        if r.high >= target:
            return "target_2", target, g.date[k]
        if held >= max_hold:
            return "max_hold", r.close, g.date[k]
    return None


@pytest.mark.parametrize("fills", [False, True])
def test_three_phase(bars, walks, plains, fills):
    numbered = I.indicators(bars)
    own = numbered.where("i >= 30 and i % 9 = 0").select("ticker", F.col("date").alias("entry_date"), F.col("close").alias("entry_price"), "atr", (F.col("close") + 4 * F.col("atr")).alias("target_2"))
    got = {(r.ticker, r.entry_date): r for r in X.three_phase(own, numbered, 90, 200, realistic_fills=fills).collect()}
    seen = set()
    for t, g in walks.items():
        for at in range(36, len(g), 9):
            a = plains[t]["atr"].iloc[at]
            want = plain_exit(g, at, g.close[at], a, g.close[at] + 4 * a, 90, B.Config(), fills)
            r = got[t, g.date[at]]
            if want is None:
                assert r.exit_reason is None
            else:
                seen.add(want[0])
                assert (r.exit_reason, r.exit_date) == (want[0], want[2]) and abs(r.exit_price - want[1]) < 0.0051
    assert {"stop_guard", "stop_trail", "stop_breakeven", "target_2"} <= seen


def call(s, k, t, rate=0.04, iv=0.38):
    d1 = (math.log(s / k) + (rate + iv * iv / 2) * t) / (iv * math.sqrt(t))
    n = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    return s * n(d1) - k * math.exp(-rate * t) * n(d1 - iv * math.sqrt(t))


def plain_option(g, at):
    if at + 1 >= len(g) or len(g) - at - 2 < 5:
        return None
    e = at + 1
    k = g.open[e]
    premium, peak, armed = call(k, k, 45 / 365), None, False
    days = min(40, len(g) - e - 1)
    for n in range(1, days + 1):
        t = max(45 - n, 1) / 365
        hi, lo, cl = (call(g[c][e + n], k, t) for c in ("high", "low", "close"))
        out = None
        if n <= 5:
            if lo <= premium * 0.6:
                out = "guard_floor", premium * 0.6, g.low[e + n]
        else:
            peak = cl if peak is None else max(peak, cl)
            if lo <= premium * 0.8:
                out = "stop_loss", premium * 0.8, g.low[e + n]
            else:
                armed = armed or hi >= premium * 1.15
                if armed and cl <= peak * 0.95:
                    out = "trailing_stop", peak * 0.95, g.close[e + n]
        if out is None and n == days:
            out = "time_exit", cl, g.close[e + n]
        if out:
            return g.date[e], g.date[e + n], n, out[0], (out[1] - premium) / premium * 100, (out[2] - k) / k * 100, armed, premium if peak is None else peak


def test_option_paths(bars, walks):
    numbered = I.numbered(bars)
    signals = numbered.where("i % 4 = 1").select("ticker", F.col("date").alias("signal_date"))
    got = {(r.ticker, r.signal_date): r for r in X.option_paths(signals, numbered).collect()}
    want = {(t, g.date[at]): plain_option(g, at) for t, g in walks.items() for at in range(1, len(g), 4)}
    assert set(got) == {k for k, v in want.items() if v}
    near = 0
    for key, r in got.items():
        w = want[key]
        if (r.entry_date, r.exit_date, r.days_held, r.exit_reason, r.armed) != (*w[:4], w[6]):
            near += 1  # the polynomial differs in the eighth digit
            continue
        assert abs(r.option_pnl_pct - w[4]) < 0.02 and abs(r.stock_pnl_pct - w[5]) < 0.0051 and abs(r.peak_option_value - w[7]) < 0.01
    assert near <= 1 and len({r.exit_reason for r in got.values()}) >= 3


def plain_backtest(walks, plains, c, sectors):
    """The same rules day by day on frames, without any of the engine's parts."""
    frames = {}
    for t, g in walks.items():
        p = plains[t].iloc[: len(g)]
        w = S.no_pcr_weights(c.weights)
        f = g.copy()
        f["atr"], f["avg"] = p["atr"].round(2), p["avg_volume"].round()
        ok = (f.index >= 256) & (p["rsi"] <= 50) & (p["atr"] > 0)
        f["score"] = [round(sum(w[k] * s for k, s in plain_scores(p.iloc[i]).items()), 2) if ok[i] else np.nan for i in range(len(f))]
        frames[t] = f.set_index("date", drop=False)
    days = sorted({d for f in frames.values() for d in f.index})
    lo, hi = datetime.date.fromisoformat(c.start), datetime.date.fromisoformat(c.end)
    reviews, seen = [], set()
    for n, d in enumerate(days):
        if lo <= d <= hi and (d.year, d.month) not in seen:
            seen.add((d.year, d.month))
            if n >= 252:
                reviews.append(d)
    cash, book, out, marks, last = c.initial_capital, {}, [], [], lo

    def fee(n, price):
        return min(max(abs(n) * 0.005, 1.0), abs(n) * price * 0.01)

    def sell(t, price, day, why):
        nonlocal cash
        p = book.pop(t)
        price *= 1 - c.slippage_pct
        cash += p["n"] * price - fee(p["n"], price)
        out.append((t, p["day"], day, why, round((price - p["entry"]) / p["entry"] * 100, 2)))

    for review in reviews:
        for t in list(book):
            p, f = book[t], frames[t]
            for d in [d for d in f.index if last < d <= review]:
                r, held = f.loc[d], (d - p["day"]).days
                p["peak"] = max(p["peak"], r.high)
                if held < 15:
                    why, stop = "stop_guard", p["entry"] - 3 * p["atr"]
                elif p["peak"] >= p["entry"] + p["atr"]:
                    why, stop = "stop_trail", max(p["peak"] - 2.5 * p["atr"], p["entry"])
                else:
                    why, stop = "stop_breakeven", p["entry"]
                if r.low <= stop:
                    sell(t, round(stop, 2), d, why)
                    break
                if r.high >= p["target"]:
                    sell(t, p["target"], d, "target_2")
                    break
            else:
                if last < f.index[-1] <= review:
                    sell(t, f.close.iloc[-1], f.index[-1], "delisted")
        for t in list(book):
            f = frames[t].loc[:review]
            s = f.score.iloc[-1]
            if not np.isnan(s):
                if s < c.exit_score_threshold:
                    sell(t, f.close.iloc[-1], review, "score_deterioration")
                elif f.atr.iloc[-1] > 0:
                    book[t]["atr"] = f.atr.iloc[-1]
        slots, free = c.top_n - len(book), cash * (1 - c.cash_pct)
        if slots > 0 and free > 100:
            found = []
            for t in sorted(frames):
                f = frames[t]
                f = f[f.index < review]
                if t not in book and len(f) and f.score.iloc[-1] >= c.signal_threshold:
                    found.append((t, f.score.iloc[-1], f.atr.iloc[-1], f.avg.iloc[-1]))
            found.sort(key=lambda x: -x[1])
            taken = {}
            for t in book:
                taken[sectors[t]] = taken.get(sectors[t], 0) + 1
            picked = []
            for x in found:
                if len(picked) < slots and (not c.use_sectors or taken.get(sectors[x[0]], 0) < c.max_per_sector):
                    picked.append(x)
                    taken[sectors[x[0]]] = taken.get(sectors[x[0]], 0) + 1
            for t, s, a, v in picked:
                if review not in frames[t].index:
                    continue
                price = frames[t].loc[review].open * (1 + c.slippage_pct)
                if c.sizing_method == "atr_risk_based":
                    n = min(min(cash * 0.01 / (1.5 * a), 0.2 * cash / price, 0.01 * v), free / price)
                else:
                    n = min(free / c.top_n, cash) / price
                cash -= n * price + fee(n, price)
                book[t] = {"n": n, "entry": price, "day": review, "atr": a, "target": round(price + 4 * a, 2), "peak": price}
        marks.append((review, cash + sum(p["n"] * frames[t].loc[:review].close.iloc[-1] for t, p in book.items())))
        last = review
    final = [d for d in days if d <= hi][-1]
    for t in list(book):
        sell(t, frames[t].loc[:final].close.iloc[-1], final, "end_of_backtest")
    return out, marks, cash


def test_backtest(spark, bars, walks, plains):
    cut = bars.where("ticker <> 'T002' or date < date '2016-10-20'")  # one stops trading
    own = {t: g[g.date < datetime.date(2016, 10, 20)] if t == "T002" else g for t, g in walks.items()}
    sectors = {t: f"S{k % 2}" for k, t in enumerate(sorted(own))}
    base = B.Config(start="2015-06-01", end="2016-12-15", signal_threshold=4.0, exit_score_threshold=3.0, top_n=3)
    configs = [base, B.replace(base, name="risk", sizing_method="atr_risk_based"), B.replace(base, name="sectors", use_sectors=True, max_per_sector=1, top_n=5)]
    table = spark.createDataFrame(list(sectors.items()), "ticker string, sector string")
    results = B.run(B.panel(cut, min_avg_volume=0.0), configs, B.world(cut, sectors=table)).cache()
    reasons = set()
    for c in configs:
        want, marks, cash = plain_backtest(own, plains, c, sectors)
        mine = results.where(F.col("config") == c.name)
        got = sorted((r.ticker, r.entry_date, r.exit_date, r.exit_reason, r.pnl_pct) for r in B.trades(mine).collect())
        assert [x[:4] for x in got] == [x[:4] for x in sorted(want)] and len(want) >= 5
        assert all(abs(a[4] - b[4]) < 0.011 for a, b in zip(got, sorted(want)))
        equity = sorted((r.date, r.portfolio_value) for r in B.equity(mine).collect())
        assert [d for d, _ in equity] == [d for d, _ in marks] and all(close(a[1], b[1]) for a, b in zip(equity, marks))
        assert close(mine.where("kind = 'end'").first().capital, cash)
        reasons |= {x[3] for x in want}
    assert len(reasons) >= 4
    s = {r.config: r for r in B.summary(results, configs).collect()}
    assert s["base"].n_trades == len(plain_backtest(own, plains, base, sectors)[0]) and all(r.error is None for r in s.values())


def test_runs_that_fail_and_configs(spark, bars):
    panel, world = B.panel(bars, min_avg_volume=0.0), B.world(bars)
    bad = B.Config(name="bad", start="no date")
    s = {r.config: r for r in B.summary(B.run(panel, [B.Config(), bad], world), [B.Config(), bad]).collect()}
    assert "ValueError" in s["bad"].error and s["bad"].n_trades is None and s["base"].error is None
    assert len(B.grid(B.Config(), {"top_n": (3, 5), "guard_days": (10, 15, 20)})) == 6
    assert [c.commission_min for c in B.cost_stress(B.Config())] == [1.0] * 3 and B.cost_stress(B.Config())[2].slippage_pct == 0.0015
    with pytest.raises(ValueError, match="sizing"):
        B.Config(sizing_method="none")
    with pytest.raises(ValueError, match="locked"):
        B.check_locked(B.Config(top_n=7), {"top_n": 5})
    B.check_locked(B.Config(), {"top_n": 5})


def test_tails_and_normals(spark):
    assert close(tails.t_two_sided(2.228138852, 10), 0.05, 1e-8) and close(tails.t_two_sided(1.959963985, 1e7), 0.05, 1e-6) and tails.t_two_sided(None, 3) is None
    assert close(tails.normal_quantile(0.975), 1.959963984540054) and tails.required_periods(0, 1) == math.inf
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 2.0, 4.0, 9.0]
    t, p = tails.welch(np.mean(a), np.var(a, ddof=1), 5, np.mean(b), np.var(b, ddof=1), 4)
    assert close(t, (3 - 4.25) / math.sqrt(2.5 / 5 + np.var(b, ddof=1) / 4)) and 0.4 < p < 0.7
    xs = [(x / 10,) for x in range(-60, 61)]
    for r in spark.createDataFrame(xs, "x double").select("x", finance.normal_cdf(F.col("x")).alias("p")).collect():
        assert abs(r.p - 0.5 * math.erfc(-r.x / math.sqrt(2))) < 8e-8


def test_trade_significance_is_whole(spark):
    r = np.random.default_rng(6)
    days = [datetime.date(2001, 1, 1) + datetime.timedelta(days=int(d)) for d in r.integers(0, 300, 60)]
    x, pnl = np.round(r.normal(0.5, 3, 60), 1), np.round(r.normal(5, 90, 60), 2)
    x[:4], days[:4] = 9.5, [datetime.date(2003, 1, 9), datetime.date(2001, 2, 1), datetime.date(2001, 2, 1), datetime.date(2001, 5, 3)]  # the best are equal
    x[4], days[4] = 30.0, datetime.date(2004, 4, 4)  # the best is alone in its month
    rows = [(d, float(a), float(b)) for d, a, b in zip(days, x, pnl)] + [(None, 1000.0, 5000.0), (days[0], math.nan, 7000.0), (days[0], None, 1.0)]
    got = V.trade_significance(spark.createDataFrame(rows, "entry_date date, pnl_pct double, pnl double").repartition(3), draws=50)

    def tested(v, d):
        key = np.array([(k.year, k.month) for k in d])
        u = [(v[(key == k).all(1)] - v.mean()).sum() for k in {tuple(k) for k in key}]
        return v.mean(), v.mean() / (math.sqrt(len(u) / (len(u) - 1) * sum(a * a for a in u)) / len(v)), len(u)

    mean, t, g = tested(x, days)
    assert got["n"] == 60 and got["n_clusters"] == g and math.isclose(got["t_cluster"], t, rel_tol=1e-9) and math.isclose(got["p_cluster"], tails.t_two_sided(t, g - 1), rel_tol=1e-7)
    assert math.isclose(got["median"], np.median(x)) and math.isclose(got["trimmed_mean"], np.sort(x)[3:-3].mean()) and math.isclose(got["win_rate"], (x > 0).mean() * 100)
    assert math.isclose(got["skew"], ((x - mean) ** 3).mean() / x.std() ** 3) and math.isclose(got["excess_kurtosis"], ((x - mean) ** 4).mean() / x.std() ** 4 - 3)
    nz = x[x != 0]
    ranks = pd.Series(np.abs(nz)).rank().to_numpy()
    assert math.isclose(got["p_wilcoxon"], tails.wilcoxon(len(nz), ranks[nz > 0].sum(), sum(c**3 - c for c in pd.Series(np.abs(nz)).value_counts())))
    by = sorted(range(60), key=lambda i: (-x[i], days[i]))
    for k in (1, 3, 5, 10):
        rest = sorted(by[k:])
        m, t, _ = tested(x[rest], [days[i] for i in rest])
        assert math.isclose(got[f"mean_excl_top{k}"], m) and math.isclose(got[f"t_cluster_excl_top{k}"], t, rel_tol=1e-9)
        assert math.isclose(got[f"share_of_total_pnl_top{k}"], np.sort(pnl)[::-1][:k].sum() / pnl.sum())
    few = V.trade_significance(spark.createDataFrame(rows[5:13], "entry_date date, pnl_pct double, pnl double").drop("pnl"), draws=5)
    assert few["mean_excl_top1"] is not None and few["mean_excl_top3"] is None and few["share_of_total_pnl_top1"] is None
    signs = np.array(list(itertools.product((0, 1), repeat=11))) @ np.arange(1, 12)
    assert math.isclose(tails.wilcoxon(11, 50.0, 0), 2 * (signs >= 50).mean()) and tails.wilcoxon(11, 33.0, 0) == 1.0


def test_inference(spark):
    r = np.random.default_rng(1)
    rows = [(datetime.date(2000, 1, 1) + datetime.timedelta(days=int(d)), float(x), float(10 * x)) for d, x in zip(r.integers(0, 900, 400), np.round(r.normal(0.4, 3, 400), 1))]
    t = spark.createDataFrame(rows, "entry_date date, pnl_pct double, pnl double")
    x = np.array([v for _, v, _ in rows])
    key = np.array([(d.year, d.month) for d, _, _ in rows])
    sums = [(x[(key == k).all(1)] - x.mean()).sum() for k in {tuple(k) for k in key}]
    g = len(sums)
    got = V.trade_significance(t, draws=2000)
    assert got["n_clusters"] == g and close(got["se_cluster"], math.sqrt(g / (g - 1) * sum(s * s for s in sums)) / 400, 1e-4)
    nz = x[x != 0]
    ranks = pd.Series(np.abs(nz)).rank().to_numpy()
    ties = sum(c**3 - c for c in pd.Series(np.abs(nz)).value_counts())
    assert close(got["p_wilcoxon"], tails.wilcoxon(len(nz), ranks[nz > 0].sum(), ties))
    assert got["ci_low"] < x.mean() < got["ci_high"] and abs((got["ci_high"] - got["ci_low"]) / (2 * 1.96 * got["se_cluster"]) - 1) < 0.15
    size = V.sample_size(got["mean"], got["sd"], got["n"], got["n_eff"], 2.5)
    assert size["required_n_eff"] > 0 and V.window_independence("2000-01-01", "2010-01-01")["n_windows"] == 17
    y, z = r.normal(0.01, 0.04, 80), r.normal(0.008, 0.03, 80)
    y = y + 0.8 * z
    pairs = spark.createDataFrame([(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(y, z))], "t int, y double, x double")
    o = V.ols_hac(pairs).first()
    m = np.column_stack([np.ones(80), z])
    inv = np.linalg.inv(m.T @ m)
    b = inv @ m.T @ y
    e = (y - m @ b)[:, None] * m
    lags = int(4 * 0.8 ** (2 / 9))
    s = e.T @ e
    for k in range(1, lags + 1):
        c = e[k:].T @ e[:-k]
        s = s + (1 - k / (lags + 1)) * (c + c.T)
    se = np.sqrt(np.diag(inv @ s @ inv * 80 / 78))
    assert o.lags == lags and close(o.alpha, b[0]) and close(o.beta, b[1]) and close(o.se_alpha, se[0]) and close(o.se_beta, se[1])
    k = np.array([r.t for r in V.stationary_draws(pairs, 60, 10, pairs.agg(F.count("*").alias("n_")), 5).collect()]).reshape(60, 80)
    assert 0.88 < np.mean((np.diff(k) % 80) == 1) < 0.92 and k.min() == 1 and k.max() == 80 and np.ptp(np.bincount(k.ravel())[1:]) < 60
    dates = [datetime.date(2000 + i // 12, i % 12 + 1, 1) for i in range(81)]
    v, w = 100 * np.cumprod(np.r_[1, 1 + y]), 50 * np.cumprod(np.r_[1, 1 + z])
    a = V.alpha_test(spark.createDataFrame([(d, float(q)) for d, q in zip(dates, v)], "date date, portfolio_value double"), spark.createDataFrame([(d, float(q)) for d, q in zip(dates, w)], "date date, close double"), draws=500)
    assert close(a["alpha"], b[0]) and a["alpha_ci"][0] < a["alpha_annual_pct"] < a["alpha_ci"][1] and close(a["sharpe"], y.mean() / y.std(ddof=1) * math.sqrt(12))
    with pytest.raises(ValueError, match="24"):
        V.alpha_test(spark.createDataFrame([(dates[0], 1.0)], "date date, portfolio_value double"), spark.createDataFrame([(dates[0], 1.0)], "date date, close double"))


def test_weight_sensitivity(spark):
    r = np.random.default_rng(2)
    rows = [(datetime.date(2001, 1, 1 + d), f"t{k}", *[float(v) for v in r.integers(0, 11, 5)]) for d in range(3) for k in range(30 if d else 3)]
    p = pd.DataFrame(rows, columns=["date", "ticker", *D.SUBSCORES])
    got = D.weight_sensitivity(spark.createDataFrame(rows, "date date, ticker string, " + ", ".join(f"{c} double" for c in D.SUBSCORES)), draws=5, top_n=10).toPandas()
    assert set(got.date) == {datetime.date(2001, 1, 2), datetime.date(2001, 1, 3)} and len(got) == 10
    q = np.random.default_rng(42)
    drawn = np.column_stack([q.uniform(*D.BOUNDS[c], 5) for c in D.SUBSCORES])
    own = S.no_pcr_weights()
    for _, x in got.iterrows():
        g = p[p.date == x.date].sort_values("ticker")
        a = sum(g[c] * own[c] for c in D.SUBSCORES).round(9)
        b = sum(g[c] * w for c, w in zip(D.SUBSCORES, drawn[x.draw] / drawn[x.draw].sum())).round(9)
        assert close(x.spearman, a.rank().corr(b.rank()), 1e-9) and close(x.delta, (a - b).abs().mean(), 1e-9)


def test_scalars():
    own = S.adjust_weight({"w": 1, "s_rsi": 0.5, "s_bb": 0.5}, "s_rsi", 0.2)
    assert own == {"w": 1, "s_rsi": 0.2, "s_bb": 0.8}
    for args in (({"s_rsi": 1.0}, "s_bad", 0.1), ({"s_rsi": 1.0}, "s_rsi", 0.1)):
        with pytest.raises(ValueError, match="weight"):
            S.adjust_weight(*args)
    assert S.no_pcr_weights({"s_rsi": 0.0, "s_bb": 0.0, "s_pcr": 1.0}) == {"s_rsi": 0.5, "s_bb": 0.5}


def test_labels(spark):
    rows = [(None, None), (float("nan"), -5.0), (float("inf"), 1e9), (2.345, 2e10), (-1.0, 6e11)]
    x = spark.createDataFrame(rows, "x double, cap double").select(S.formatted(F.col("x"), 1).alias("f"), S.cap_tier(F.col("cap")).alias("t"), S.score_bollinger(F.col("x")).alias("b"), S.score_rsi(F.col("x")).alias("r")).collect()
    assert [r.f for r in x] == ["N/A", "N/A", "inf", "2.3", "-1.0"] and [r.t for r in x] == ["Unknown", "Unknown", "Small", "Mid", "Mega"] and [r.b for r in x] == [5.0, 5.0, 1.0, 1.0, 10.0]


def test_asof_and_members(spark):
    left = spark.createDataFrame([("a", 1, 5), ("a", 2, 10), ("a", 3, 1), ("b", 4, 5)], "k string, id int, t int")
    right = spark.createDataFrame([("a", 5, "five"), ("a", 7, "seven"), ("b", 6, "six")], "k string, t int, v string")
    get = lambda **how: {r.id: r.v for r in T.asof(left, right, ["k"], "t", ["v"], **how).collect()}
    assert get() == {1: "five", 2: "seven", 3: None, 4: None}
    assert get(exact=False) == {1: None, 2: "seven", 3: None, 4: None}
    assert get(forward=True) == {1: "five", 2: None, 3: "five", 4: "six"}
    assert get(forward=True, exact=False) == {1: "seven", 2: None, 3: "five", 4: "six"}
    d = lambda s: datetime.date.fromisoformat(s)
    m = spark.createDataFrame([("x", d("2000-01-15"), d("2000-03-10")), ("x", d("2000-03-01"), None), ("y", d("2000-02-01"), d("2000-02-01"))], "ticker string, date_added date, date_removed date")
    days = spark.createDataFrame([(d(s),) for s in ("2000-01-14", "2000-01-15", "2000-02-01", "2000-03-05", "2001-07-01")], "date date")
    got = sorted((str(r.date), r.ticker) for r in T.members_on(days, m).collect())
    assert got == [("2000-01-15", "x"), ("2000-02-01", "x"), ("2000-02-01", "y"), ("2000-03-05", "x"), ("2001-07-01", "x")]
    assert T.members_on(days, m, False).where("ticker = 'y'").count() == 0 and T.active_on(m, "2000-02-01").count() == 1


def test_files(spark, tmp_path, bars):
    path = str(tmp_path)
    h = spark.createDataFrame([("2020-01-01", 1.0), ("2020-01-02", 2.0)], "date string, portfolio_value double")
    full = lambda x: x.select(*[F.col(c).cast(t) if c in x.columns else F.lit(None).cast(t).alias(c) for c, t in (f.split(" ") for f in sources.SCHEMAS["history"].split(", "))])
    sources.rebuild_history(full(h), f"{path}/h")
    for _ in range(2):  # again changes nothing
        sources.upsert_history(spark, f"{path}/h", full(spark.createDataFrame([("2020-01-02", 5.0), ("2020-01-03", 6.0)], "date string, portfolio_value double")))
    assert sorted((r.date, r.portfolio_value) for r in sources.ledger(spark, f"{path}/h", "history").collect()) == [("2020-01-01", 1.0), ("2020-01-02", 5.0), ("2020-01-03", 6.0)]
    assert sources.ledger(spark, f"{path}/none").count() == 0 and sources.log(spark, f"{path}/none", "a int").count() == 0
    scored = SC.scan(bars, min_avg_volume=0.0, rsi_max=200.0, min_score=-1.0)
    row = L.position_row(scored, "T001", 3, "2020-02-02")
    sources.append_csv(row, f"{path}/p")
    sources.append_csv(L.position_row(scored, "T002", 4, "2020-02-03"), f"{path}/p")
    back = sources.ledger(spark, f"{path}/p").orderBy("ticker").collect()
    assert [(r.ticker, r.shares, r.status, r.exit_date) for r in back] == [("T001", 3.0, "open", None), ("T002", 4.0, "open", None)] and back[0].entry_price == row.first().entry_price
    with pytest.raises(ValueError, match="NONE"):
        L.position_row(scored, "NONE", 1, "2020-02-02")
    old = L.historical_position_row(SC.score_history(bars, min_avg_volume=0.0), "T001", 2, "2016-08-01", 91.5).first()
    assert old.entry_price == 91.5 and old.status == "open"
    bars.write.parquet(f"{path}/bars")
    some = sources.bars(spark, f"{path}/bars", "2016-01-01", "2016-02-01", ["T001"])
    assert some.count() == bars.where("ticker = 'T001' and date between date '2016-01-01' and date '2016-02-01'").count() > 20
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ticker,T001)" in plan and "GreaterThanOrEqual(date,2016-01-01)" in plan
    calls = []
    load = lambda: calls.append(1) or h
    for age in (24, 24, 0):
        assert sources.cached(spark, f"{path}/cache", age, load).count() == 2
    assert len(calls) == 2
    with pytest.raises(PermissionError):
        sources.single_shot(spark, path, {"a": 1}, dict)
    assert sources.single_shot(spark, path, {"a": 1}, lambda: {"r": 2}, confirm=True) == {"r": 2}
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        sources.single_shot(spark, path, {"a": 1}, lambda: {"r": 2}, confirm=True)
    assert any("earlier" in str(x.message) for x in w)
    (tmp_path / "m.csv").write_text("ticker,date_added,date_removed\nA,2000-06-05,\nB,1999-12-08,2017-06-19\n")
    assert [(r.ticker, str(r.date_removed)) for r in sources.membership(spark, f"{path}/m.csv").orderBy("ticker").collect()] == [("A", "None"), ("B", "2017-06-19")]


def test_streams(spark, tmp_path):
    path = str(tmp_path)
    ts = lambda d, h: datetime.datetime(2020, 1, d, h)
    ticks = spark.createDataFrame([("a", ts(1, 9), 1.0, 5.0), ("a", ts(1, 10), 3.0, 5.0), ("a", ts(1, 11), 2.0, 1.0), ("a", ts(2, 9), 7.0, 1.0)], "ticker string, ts timestamp, price double, size double")
    ticks.write.parquet(f"{path}/ticks")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{path}/ticks")
    streaming.daily_bars(stream).writeStream.format("memory").queryName("bars_q").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {str(r.date): (r.open, r.high, r.low, r.close, r.volume) for r in spark.table("bars_q").collect()}
    assert got == {"2020-01-01": (1.0, 3.0, 1.0, 2.0, 11.0), "2020-01-02": (7.0, 7.0, 7.0, 7.0, 1.0)}
    signals = ticks.select("ticker", "ts", F.col("price").alias("score"))
    assert [r.n for r in streaming.signal_sessions(signals, "3 hours").orderBy("first").collect()] == [3, 1]
    columns = [f.split(" ") for f in sources.SCHEMAS["history"].split(", ")]
    for k, value in enumerate((1.0, 2.0)):
        spark.createDataFrame([("2020-01-01", value)], "date string, portfolio_value double").select(*[F.col(c).cast(t) if c in ("date", "portfolio_value") else F.lit(None).cast(t).alias(c) for c, t in columns]).write.mode("append").parquet(f"{path}/rows")
        q = streaming.upsert_batches(spark.readStream.schema(sources.SCHEMAS["history"]).parquet(f"{path}/rows"), f"{path}/h", f"{path}/ck")
        q.awaitTermination()
        assert [(r.date, r.portfolio_value) for r in sources.ledger(spark, f"{path}/h", "history").collect()] == [("2020-01-01", value)]
    assert streaming.first_days(spark.createDataFrame([(datetime.date(2020, 1, 3),), (datetime.date(2020, 1, 2),)], "date date")).first().review_date == datetime.date(2020, 1, 2)


def test_monte_carlo_shuffles(spark):
    pnl = [float(x) for x in np.random.default_rng(3).normal(0, 8, 60)]
    got = monte_carlo.simulate(spark.createDataFrame(list(enumerate(pnl)), "k int, pnl_pct double"), 12, method="shuffle").toPandas()
    growth = np.array([1 + x / 500 for x in sorted(pnl)])
    assert np.allclose(got.total_return, (growth.prod() - 1) * 100) and got.max_drawdown.nunique() > 6
    for k, deepest in zip(got.simulation, got.max_drawdown):
        path = np.r_[1, np.cumprod(growth[monte_carlo.Draws(60, method="shuffle").path(int(k))])]
        assert close(deepest, ((path - np.maximum.accumulate(path)) / np.maximum.accumulate(path)).min() * 100)
    with pytest.raises(ValueError, match="method"):
        monte_carlo.simulate(spark.createDataFrame([(1, 1.0)], "k int, pnl_pct double"), method="other")
