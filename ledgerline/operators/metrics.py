"""Statistics of trades and equity curves.

Trades have pnl, pnl_pct and, where named, entry_date, exit_date, exit_reason, regime,
signal_score. Equity curves have date and portfolio_value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from . import order
from .keep import kept
from .ranges import carried, cuts, with_range

FIRST = Window.unboundedPreceding


def _trade_columns(won: Column | None = None) -> dict[str, Column]:
    won = F.col("pnl") > 0 if won is None else won
    n, wins = F.count("*"), F.count_if(won)
    avg_win, avg_loss = F.coalesce(F.avg(F.when(won, F.col("pnl_pct"))), F.lit(0.0)), F.coalesce(F.avg(F.when(~won, F.col("pnl_pct"))), F.lit(0.0))
    return {"n": n, "wins": wins, "avg_win": avg_win, "avg_loss": avg_loss, "mean": F.avg("pnl_pct"), "sd": F.stddev_samp("pnl_pct"), "mean_pnl": F.avg("pnl")}


def _profit_factor() -> Column:
    lost = F.abs((F.col("n") - F.col("wins")) * F.col("avg_loss"))
    return F.when(lost > 0, F.col("wins") * F.col("avg_win") / lost).otherwise(0.0)


def trade_stats(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n_trades, win_rate, avg_win, avg_loss, profit_factor, expectancy_pct, expectancy_abs, rounded to 2; 0 without trades. A trade without profit is a loss."""
    x = trades.groupBy(*by).agg(*[c.alias(k) for k, c in _trade_columns().items()])
    p = F.when(F.col("n") > 0, F.col("wins") / F.col("n")).otherwise(0.0)
    own = {
        "win_rate": p * 100, "avg_win": F.col("avg_win"), "avg_loss": F.col("avg_loss"), "profit_factor": _profit_factor(),
        "expectancy_pct": p * F.col("avg_win") + F.when(F.col("n") > 0, 1 - p).otherwise(0.0) * F.col("avg_loss"), "expectancy_abs": F.coalesce("mean_pnl", F.lit(0.0)),
    }
    return x.select(*by, F.col("n").alias("n_trades"), *[F.round(c, 2).alias(k) for k, c in own.items()])


def equity_stats(equity: DataFrame, initial: Column | None = None, final: Column | None = None, by: Sequence[str] = (), start=None, end=None, periods: int = 12, rf: float = 0.0, ranges: int | None = None) -> DataFrame:
    """total_return, annual_return, max_drawdown, sharpe_ratio, sortino_ratio, calmar_ratio, rounded to 2.

    Without ``initial`` or ``final`` the curve's first and last value stand in, without dates its first and last date. Sortino divides by
    the sample deviation of the negative excess returns; where that is undefined it is infinite for a positive mean, else 0.
    ``ranges`` cuts the curves into so many ranges of time; the last value and the peak of the earlier ones are carried into each.
    """
    v = F.col("portfolio_value").cast("double")
    if ranges:
        x = with_range(equity, "date", cuts(equity, "date", ranges))
        x = carried(x, by, {"last_": F.max_by(v, "date"), "top_": F.max(v)}, {"last_": F.last("last_"), "top_": F.max("top_")})
        w = Window.partitionBy(*by, "range_").orderBy("date")
        first = F.row_number().over(w) == 1
        before, peak = F.when(first, F.col("last_")).otherwise(F.lag(v).over(w)), F.greatest(F.max(v).over(w.rowsBetween(FIRST, 0)), "top_")
    else:
        x, w = equity, Window.partitionBy(*by).orderBy("date")
        before, peak = F.lag(v).over(w), F.max(v).over(w.rowsBetween(FIRST, 0))
    x = x.select(*by, "date", v.alias("v"), (v / before - 1 - rf / periods).alias("r"), ((v - peak) / peak * 100).alias("dd"))
    x = x.groupBy(*by).agg(
        F.count("v").alias("n"), F.count("r").alias("n_r"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("down"), F.min("dd").alias("dd"),
        F.min_by("v", "date").alias("v0"), F.max_by("v", "date").alias("v1"), F.min("date").cast("date").alias("d0"), F.max("date").cast("date").alias("d1"),
    )
    first, last = F.col("v0") if initial is None else initial, F.col("v1") if final is None else final
    d0, d1 = F.col("d0") if start is None else F.lit(start).cast("date"), F.col("d1") if end is None else F.lit(end).cast("date")
    years = F.datediff(d1, d0) / 365.25
    growth = last / first
    annual = F.when((years > 0) & (growth > 0), (F.pow(growth, 1 / years) - 1) * 100).otherwise(0.0)
    root = F.sqrt(F.lit(float(periods)))
    sortino = F.when(F.col("down") > 0, F.col("mu") / F.col("down") * root).when((F.col("n_r") > 1) & (F.col("mu") > 0), float("inf")).otherwise(0.0)
    own = {
        "total_return": (growth - 1) * 100, "annual_return": annual, "max_drawdown": F.col("dd"),
        "sharpe_ratio": F.when((F.col("n_r") > 1) & (F.col("sd") > 0), F.col("mu") / F.col("sd") * root).otherwise(0.0), "sortino_ratio": sortino,
        "calmar_ratio": F.when(F.col("dd") != 0, F.round(annual, 2) / F.abs(F.col("dd"))).otherwise(0.0),
    }
    rounded = lambda c: F.when(F.abs(c) == float("inf"), c).otherwise(F.round(F.coalesce(c, F.lit(0.0)), 2))
    return x.select(*by, *[rounded(c).alias(k) for k, c in own.items()])


def standard_metrics(trades: DataFrame, equity: DataFrame, initial: Column | None = None, final: Column | None = None, by: Sequence[str] = (), **how) -> DataFrame:
    """All of them in one row (for each value of ``by``)."""
    a, b = trade_stats(trades, by), equity_stats(equity, initial, final, by, **how)
    return a.join(b, list(by)) if by else a.crossJoin(b)  # one row each


def reliability(trades: DataFrame) -> DataFrame:
    """dimension, value, n_trades, win_rate, avg_pnl, avg_win, avg_loss, avg_hold by regime, score bucket and exit reason, in one pass."""
    x = trades.withColumns({"bucket": S.score_bucket(F.col("signal_score")), "held_": F.datediff("exit_date", "entry_date")})
    x = x.groupingSets([[F.col("regime")], [F.col("bucket")], [F.col("exit_reason")]], "regime", "bucket", "exit_reason").agg(
        F.grouping("regime").alias("g1"), F.grouping("bucket").alias("g2"), F.count("*").alias("n_trades"), F.round(F.count_if(F.col("pnl_pct") > 0) / F.count("*") * 100, 4).alias("win_rate"), F.round(F.avg("pnl_pct"), 4).alias("avg_pnl"),
        F.round(F.avg(F.when(F.col("pnl_pct") > 0, F.col("pnl_pct"))), 4).alias("avg_win"), F.round(F.avg(F.when(F.col("pnl_pct") <= 0, F.col("pnl_pct"))), 4).alias("avg_loss"), F.round(F.avg("held_"), 4).alias("avg_hold"),
    )
    dimension = F.when(F.col("g1") == 0, "regime").when(F.col("g2") == 0, "score").otherwise("exit")
    return x.select(dimension.alias("dimension"), F.coalesce("regime", "bucket", "exit_reason").alias("value"), "n_trades", "win_rate", "avg_pnl", "avg_win", "avg_loss", "avg_hold")


def bucket_stats(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """n_trades, win_rate, avg_pnl_pct, profit_factor, trade_sharpe_approx."""
    x = trades.groupBy(*by).agg(*[c.alias(k) for k, c in _trade_columns().items()])
    sharpe = F.when(F.col("sd") > 0, F.round(F.col("mean") / F.col("sd"), 3)).otherwise(0.0)
    return x.select(*by, F.col("n").alias("n_trades"), F.round(F.col("wins") / F.col("n") * 100, 2).alias("win_rate"), F.round("mean", 2).alias("avg_pnl_pct"), F.round(_profit_factor(), 2).alias("profit_factor"), sharpe.alias("trade_sharpe_approx"))


def window_consistency(trades: DataFrame, label: str, least: int = 5) -> DataFrame:
    """Windows with enough bull and bear trades: both means, and whether bull did better."""
    side = lambda f, v: f(F.when(F.col(label) == v, F.col("pnl_pct")))
    x = trades.groupBy("window_start", "window_end").agg(side(F.avg, "bull").alias("bull"), side(F.avg, "bear").alias("bear"), side(F.count, "bull").alias("bull_n"), side(F.count, "bear").alias("bear_n"))
    x = x.where((F.col("bull_n") >= least) & (F.col("bear_n") >= least))
    return x.select("window_start", "window_end", F.round("bull", 2).alias("bull_avg_pnl"), F.round("bear", 2).alias("bear_avg_pnl"), "bull_n", "bear_n", (F.round("bull", 2) > F.round("bear", 2)).alias("bull_wins"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Value counts with their share of all rows."""
    x = df.groupBy(column).agg(F.count("*").alias("n"))
    return x.crossJoin(F.broadcast(df.agg(F.count("*").alias("all_")))).select(column, "n", F.round(F.col("n") / F.col("all_"), 4).alias("share"))  # one row


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence[str], share: bool = False) -> DataFrame:
    """Counts, or shares of the row's, a column for each of the given values."""
    x = df.where(F.col(rows).isNotNull()).groupBy(rows).pivot(columns, list(values)).count().na.fill(0, list(values))
    if not share:
        return x
    total = sum((F.col(v) for v in values), F.lit(0))
    return x.select(rows, *[F.round(F.col(v) / total, 2).alias(v) for v in values])


def concentration(trades: DataFrame) -> DataFrame:
    """months, top_month_share (percent), tickers, and whether few months make it up."""
    months = trades.groupBy(F.date_format("entry_date", "yyyy-MM").alias("m")).agg(F.count("*").alias("c"))
    top = months.agg(F.count("*").alias("months"), F.max("c").alias("top"), F.sum("c").alias("n"))
    x = top.crossJoin(trades.agg(F.countDistinct("ticker").alias("tickers")))
    share = F.col("top") / F.col("n") * 100
    return x.select("months", "n", "tickers", F.round(share, 4).alias("top_month_share"), F.when((F.col("months") <= 3) | (share > 40), "concentrated").otherwise("spread_out").alias("verdict"))


def describe(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, std, min, p25, p50, p75, max of a column."""
    c = F.col(column)
    own = {"mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), "max": F.max(c)}
    x = order.meet(df.groupBy(*by).agg(F.count(c).alias("n"), *[v.alias(k) for k, v in own.items()]), order.quantiles(df, column, {f"p{k}": k / 100 for k in (25, 50, 75)}, by), by, "left")
    return x.select(*by, "n", *[F.round(k, 4).alias(k) for k in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def discount_cost(trades: DataFrame, by: str = "dispersion_bucket") -> DataFrame:
    """What smaller sizes have cost: profits over the size multiplier against profits."""
    whole = F.col("pnl") / F.col("size_mult")
    own = {"avg_pnl_pct": F.avg("pnl_pct"), "win_rate": F.count_if(F.col("pnl_pct") > 0) / F.count("*") * 100, "total_pnl": F.sum("pnl"), "total_undiscounted": F.sum(whole), "discount_cost": F.sum(whole - F.col("pnl")), "avg_size_mult": F.avg("size_mult")}
    return trades.groupBy(by).agg(F.count("*").alias("n_trades"), *[F.round(c, 2).alias(k) for k, c in own.items()])


def monthly_labels(components: DataFrame) -> DataFrame:
    """Month, most frequent regime and dispersion signal (ties to the smallest), mean dispersion."""
    most = lambda c: F.mode(F.col(c), True)
    x = components.groupBy(F.trunc("date", "month").alias("month")).agg(most("regime").alias("regime"), most("dispersion_signal").alias("dispersion_signal"), F.round(F.avg("dispersion"), 4).alias("dispersion"))
    return x.withColumn("dispersion_bucket", S.dispersion_bucket(F.col("dispersion_signal"))).drop("dispersion_signal")


def sector_strength(bars: DataFrame, sectors: DataFrame, months: int = 3) -> DataFrame:
    """month, sector, change (mean over tickers of the change of month-end closes), rank; unknown sectors are left out."""
    last = bars.where("close is not null").groupBy("ticker", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("c"))
    before = F.lag("c", months).over(Window.partitionBy("ticker").orderBy("month"))
    moved = last.withColumn("change", (F.col("c") / before - 1) * 100).join(sectors.select("ticker", "sector"), "ticker").where("sector <> 'Unknown' and change is not null")
    x = moved.groupBy("month", "sector").agg(F.round(F.avg("change"), 6).alias("change"))
    return x.withColumn("rank", F.rank().over(Window.partitionBy("month").orderBy(F.desc("change"))).cast("long"))


def config_comparison(results: DataFrame, value: str = "total_return") -> DataFrame:
    """Per config: mean, median, deviation, share of positive windows, windows in which it is the best (ties count for each)."""
    best = F.max(value).over(Window.partitionBy("window_start", "window_end"))
    x = results.withColumn("best_", F.col(value) == best)
    return x.groupBy("config").agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.percentile(value, 0.5), 4).alias("median"), F.round(F.stddev_samp(value), 4).alias("std"), F.round(F.count_if(F.col(value) > 0) / F.count(value) * 100, 4).alias("positive_pct"), F.count_if("best_").alias("wins"))


def noise(results: DataFrame, metrics: Sequence[str], digits: int = 4) -> DataFrame:
    """metric, mean, std, min, max, range over the runs."""
    long = results.unpivot([], list(metrics), "metric", "value")
    return long.groupBy("metric").agg(*[F.round(c, digits).alias(k) for k, c in {"mean": F.avg("value"), "std": F.stddev_samp("value"), "min": F.min("value"), "max": F.max("value"), "range": F.max("value") - F.min("value")}.items()])


def pivot_mean(df: DataFrame, x: str, y: str, metric: str, values: Sequence, digits: int = 4) -> DataFrame:
    """A row for each ``y``, a column for each given value of ``x``."""
    return df.groupBy(y).pivot(x, list(values)).agg(F.round(F.avg(metric), digits))


def tier_listing(caps: DataFrame) -> DataFrame:
    """Tickers of each tier, largest first: tier, n, place, ticker, market_cap."""
    w = Window.partitionBy("cap_tier")
    x = caps.withColumn("cap_tier", S.cap_tier(F.col("market_cap")))
    return x.withColumns({"n": F.count("*").over(w), "place": F.row_number().over(w.orderBy(F.desc("market_cap"), "ticker")).cast("long")}).select("cap_tier", "n", "place", "ticker", "market_cap")


def trimmed_mean(trades: DataFrame, share: float = 0.05, value: str = "pnl_pct") -> DataFrame:
    """Mean without int(share * n) of the smallest and of the largest."""
    return order.trimmed_mean(trades, value, share).select("n", F.round("trimmed", 4).alias("trimmed"))


average_ranks = order.average_ranks


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """rho: the correlation of average ranks, from the counts of distinct pairs; ranks have the mean (n + 1) / 2."""
    own = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a_"), F.col(b).cast("double").alias("b_"))
    x = kept(own.groupBy("a_", "b_").agg(F.count("*").alias("n_")), "pairs")
    for c in ("a_", "b_"):
        ranks = order.placed(x.groupBy(F.col(c).alias("v_")).agg(F.sum("n_").alias("c_")))
        x = x.join(ranks.select(F.col("v_").alias(c), (F.col("before_") + (F.col("c_") + 1) / 2).alias(f"r{c}")), c)
    x = x.crossJoin(F.broadcast(x.agg(((F.sum("n_") + 1) / 2).alias("mean_"))))  # one row
    da, db = F.col("ra_") - F.col("mean_"), F.col("rb_") - F.col("mean_")
    return x.agg(F.round(F.try_divide(F.sum(da * db * F.col("n_")), F.sqrt(F.sum(da * da * F.col("n_"))) * F.sqrt(F.sum(db * db * F.col("n_")))), 4).alias("rho"))


def top_removed(trades: DataFrame, ks: Sequence[int] = (1, 3, 5, 10), value: str = "pnl_pct") -> DataFrame:
    """k, the mean without the k best trades, and the share that the k largest profits have in all; the k best are few and found by a limit."""
    trades = kept(trades.select(value, *({"pnl"} - {value})), "trades")  # read three times
    n, total, pnl = trades.agg(F.count(value), F.sum(value), F.sum("pnl")).first()
    most = max(ks)
    best = [r[0] for r in trades.select(value).orderBy(F.desc_nulls_last(value)).limit(most).collect()]
    gains = [r[0] for r in trades.select("pnl").orderBy(F.desc_nulls_last("pnl")).limit(most).collect()]
    rows = [(k, (total - sum(best[:k])) / (n - k), sum(gains[:k]) / pnl if pnl else None) for k in ks if k < n - 5]
    return trades.sparkSession.createDataFrame(rows, "k int, mean_without double, share_of_pnl double").select(F.col("k").cast("long").alias("k"), F.round("mean_without", 4).alias("mean_without"), F.round("share_of_pnl", 4).alias("share_of_pnl"))


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Those of the named columns that there are, under their new names."""
    return df.select(*[F.col(c).alias(n) for c, n in names.items() if c in df.columns])
